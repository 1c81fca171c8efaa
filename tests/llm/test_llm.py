"""Training-data operators against brute force, on small tables with nulls, ties, repeats and clashing names."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talkgauge.llm import chat, decontaminate, exact_dedup, mixing, pii, quality, simhash, token_counts, token_files
from talkgauge.llm.components import components
from talkgauge.llm.word_encoder import WordEncoder
from talkgauge.llm.queries import PSEUDONYM_KEY

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, size bigint, row string"
ITEM = "what is the colour of the quiet river under the old stone bridge near zurvath the answer is deep green"
TEXTS = [
    "the quick brown fox jumps over the lazy dog by the river", "the quick brown fox jumps over the lazy dog by the river",
    None, "", "  \n\t ", "İstanbul ΑΣ x̱. it's we'll!! don't''", "one", "word " * 6000, "well then " + ITEM.upper() + " and more of it",
    "<|endoftext|> <|im_end|> a b\x85c", "call +1 (555) 123-4567 card 4328024104680480 bad 4328024104680481",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", [None, "a", "b"][i % 3], 1, 9, 9, "r") for i, t in enumerate(TEXTS)]
    rows += [(3, "", None, "a", None, None, None, None), (None, "no id", None, "c", None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def tokenizer():
    return token_files.public_tokenizer("word_bpe_49k.json")


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(docs, weak):
    digest = (lambda c: F.length(c) % 2) if weak else exact_dedup.md5_bytes
    got = exact_dedup.exact_groups(docs, keep="largest", content_hash=digest).collect()
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    assert len(got) == len(rows)
    for r in got:
        same = [i for i, t in rows if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256]
        ids = [i for i in same if i is not None]
        assert r.group_size == len(same) and r.keep_id == (max(ids) if ids else None) and r.kept == (r.doc_id == r.keep_id)


def test_mix(docs):
    got = mixing.mix_counts(docs).collect()
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").encode().split())
    order = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full, target = set(), {}
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        share = sum(weight[s] for s in order if s not in full)
        target = {s: 3.0 * sizes[s] if s in full else weight[s] * left / share for s in order}
        over = {s for s in order if target[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    want = [(r.doc_id, len((r.text or "").encode().split()), sizes[r.source], target[r.source]) for r in docs.collect()]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.size, r.source_size, r.target)) for r in got)
    assert all(0 <= r.copies <= 3 and r.taken == r.copies * r.size for r in got)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)


def test_simhash_components_match_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 20, dtype=np.uint64)
    prints = [int(b) ^ int(np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, k, dtype=np.uint64))) for b in base for k in (1, 2, 3, 4, 5)]
    prints = sorted(set(prints) | {0})
    signed = [(p if p < 2**63 else p - 2**64,) for p in prints]
    frame = spark.createDataFrame(signed, "print bigint")
    label = {p: p for p, in signed}
    for _ in range(len(prints)):
        for a, in signed:
            for b, in signed:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                    label[a] = label[b] = min(label[a], label[b])
    linked = {p for p, in signed if any(q != p and label[q] == label[p] for q, in signed)}
    for block in (4096, 2):
        got = {r.node: r.root for r in components(simhash.links(frame, block)).collect()}
        assert got == {p: label[p] for p in linked}


def test_simhash_groups_and_first(docs):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.simhash_groups(docs).collect()}
    assert all((r.doc_id, f"{simhash.fingerprint(r.text):016x}") in got for r in docs.collect())
    assert got[2, "0" * 16] == got[4, "0" * 16] == 2
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 not in ids and 3 not in ids and ids.count(2) == 1 and ids.count(0) == 1 and None in ids


def test_token_files_round_trip(spark, docs, tokenizer, tmp_path):
    manifest = token_files.write_token_files(docs, f"file://{tmp_path}/ids", tokenizer, file_ids=500)
    words = WordEncoder(tokenizer).tokenizer
    want = {}
    for r in docs.collect():
        ids = [*words.encode(r.text or "", add_special_tokens=False).ids, 1]
        want.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got, at = {}, 0
    for r in sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert got == want and [k for k in got if k is not None] == sorted(k for k in got if k is not None)
    # A file is closed after the batch that fills it, so tiny tables make one.
    assert manifest.count() >= 1


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31])
def test_pack(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000).astype(np.uint32)
    assert (token_files.unpack(token_files.pack(ids, bits), bits)[:1000] == ids).all()


def test_word_encoder_forgets_but_stays_right(tokenizer):
    words = WordEncoder(tokenizer, limit=5)
    column = pa.array([*TEXTS, "Σ. 'S !!! é!! ÀB,, 12ab!?"])
    ids, offsets = words.encode(column)
    want = words.tokenizer.encode_batch([t or "" for t in column.to_pylist()], add_special_tokens=False)
    assert [w.ids for w in want] == [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, ITEM), (2, "no such passage anywhere in any of these few documents at all"), (None, ITEM), (3, None)], "item_id bigint, text string")
    got = decontaminate.contaminated(docs, items).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(8, 1)]
    assert decontaminate.keep_clean(docs, items).count() == docs.count() - 1
    a, b = np.array([1, 2, 3, 4, 1]), np.array([2, 9, 4, 1, 1])
    assert decontaminate.lcs(a, b) == 3


def test_quality_on_held_out(spark):
    from talkgauge.llm.common import table
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = quality.train(docs, labels)
    rows = quality.score(docs, model).filter("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    again = quality.AdditiveModel.from_json(model.to_json())
    x = quality.features(pa.array(TEXTS))
    assert np.isfinite(x).all() and (again.scores(x) == model.scores(x)).all()


def test_quality_small_cases(docs, spark):
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, None), (None, 1)], "doc_id bigint, quality int")
    model = quality.train(docs, labels)
    assert quality.score(docs, model).count() == docs.count()
    assert quality.keep_accepted(docs, model).columns == docs.columns


def test_token_ledger(spark, tmp_path):
    ledger = token_counts.TokenLedger(spark, f"file://{tmp_path}/ledger")
    one = spark.createDataFrame([(0, "insert", 1, "a", "en", "t", 5), (0, "insert", 2, "a", None, "t", 7), (1, "insert", 2, "b", None, "t", 8),
                                 (0, "insert", None, "a", "en", "t", 9)], token_counts.CHANGES)
    two = spark.createDataFrame([(0, "revise", 1, "a", "en", "t", 3), (0, "delete", 2, None, None, "t", 0), (0, "delete", 9, "a", "en", "t", 1)], token_counts.CHANGES)
    assert ledger.commit(1, one) and not ledger.commit(1, one)
    assert sorted(map(tuple, ledger.totals().collect()), key=str) == [("a", "en", "t", 1, 5), ("b", None, "t", 1, 8)]
    with pytest.raises(ValueError):
        ledger.commit(3, two)
    assert ledger.commit(2, two) and not ledger.commit(2, two)
    assert [tuple(r) for r in ledger.totals().collect()] == [("a", "en", "t", 1, 3)]


def test_token_counts(docs, tokenizer):
    words = WordEncoder(tokenizer).tokenizer
    want = sorted(len(words.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect())
    assert sorted(r.n_tokens for r in token_counts.counted(docs, tokenizer).collect()) == want


def test_chat(spark):
    said = "<|im_end|><|im_start|>assistant ok <\\|x"
    rows = spark.createDataFrame([(1, 1, "assistant", said), (1, 0, "user", None), (1, None, "system", "s"), (None, 0, None, "é")], "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat.formatted_conversations(rows, token_files.public_tokenizer("byte_bpe_50k.json")).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(f"system\ns\nuser\n\nassistant\n{said}\n".encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[1].loss_chars == len(said)
    assert got[None].n_turns == 1 and not any(m in chat.escape(said) for m in chat.MARKS)


def test_pii(docs, spark):
    got = {r.doc_id: r for r in pii.pseudonymised(docs, PSEUDONYM_KEY).collect()}
    assert got[10].n_replaced == 2 and "4328024104680481" in got[10].text and "4328024104680480" not in got[10].text
    assert got[2].text is None and got[3].text == "" and got[0].text == TEXTS[0]
    days = spark.range(146097).select(pii.date(F.expr("cast(date_add(date'1800-01-01', cast(id as int)) as string)"), PSEUDONYM_KEY).alias("d"))
    assert days.distinct().count() == 146097


def test_empty_tables(spark, docs, tokenizer, tmp_path):
    none = docs.limit(0)
    items = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    assert exact_dedup.exact_groups(none).count() == mixing.mix_counts(none).count() == mixing.mix(none).count() == 0
    assert simhash.simhash_groups(none).count() == simhash.keep_first(none).count() == 0
    assert token_files.encoded_documents(none, f"file://{tmp_path}/none", tokenizer).count() == 0
    assert decontaminate.contaminated(none, items).count() == decontaminate.contaminated(docs, items.limit(0)).count() == 0
    assert pii.pseudonymised(none, PSEUDONYM_KEY).count() == token_counts.counted(none, tokenizer).count() == 0


def test_licences(docs, spark):
    from talkgauge.llm import licenses
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(
        [(50, "river bank\nReleased under the MIT License.\n"), (51, "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0.!!")], "doc_id bigint, text string"))
    assert sorted((r.doc_id, r.line, r.family) for r in licenses.licences(more).collect()) == [(50, 1, "MIT"), (51, 0, "Apache-2.0")]
    assert licenses.licences(docs.limit(0)).count() == 0
