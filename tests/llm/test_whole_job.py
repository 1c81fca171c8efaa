"""Operators on inputs where a shortcut would lose results."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_brute_force import MORE, feistel_digits, feistel_letters, luhn, plain_leaks, put, rows_of

from talkgauge.llm import decontaminate, licenses, pii, token_counts, token_files
from talkgauge.llm.common import table
from talkgauge.llm.queries import PSEUDONYM_KEY


def test_item_that_many_documents_hold(spark):
    items = sorted(rows_of(spark, MORE, "benchmark"), key=lambda i: i["item_id"])
    item = items[11]
    rng = np.random.default_rng(11)
    rows = []
    for n, text in enumerate(sorted({d["text"] for d in rows_of(spark, MORE) if d["text"]})):
        words = text.split()
        if n % 3 == 0:
            at = int(rng.integers(0, len(words) + 1))
            words[at:at] = item["text"].split()
        rows.append((n, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(i["item_id"], i["text"]) for i in items], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, benchmark).collect() if r.item_id == item["item_id"]}
    want = plain_leaks([{"doc_id": n, "text": t} for n, t in rows], [item])
    assert len(want) >= len(rows) / 3 and got <= want
    assert decontaminate.CANDIDATE == 0.45 and len(got) >= 0.9 * len(want)


def noisy(rng, item, keep, insert):
    out = []
    for w in item:
        out += [w] * (rng.random() < keep) + [int(rng.integers(1000, 9000))] * (rng.random() < insert)
    return out


def passes_somewhere(item, words):
    length, answer = int(np.ceil(len(item) * decontaminate.STRETCH)), item[-min(decontaminate.ANSWER_WORDS, len(item)) :]
    stretches = [words[s : s + length] for s in range(max(1, len(words) - length + 1))]
    return any(decontaminate.lcs(item, x) >= decontaminate.MATCH * len(item) and
               decontaminate.lcs(answer, x) >= decontaminate.ANSWER_MATCH * len(answer) for x in stretches)


def test_paraphrases_begun_at_any_word():
    rng = np.random.default_rng(4)
    found = wanted = 0
    for _ in range(600):
        item = rng.integers(0, 500, int(rng.integers(24, 56)))
        around = rng.integers(1000, 9000, 90)
        words = np.array([*around[:45], *noisy(rng, item.tolist(), 0.9, 0.4), *around[45:]])
        want, got = passes_somewhere(item, words), decontaminate._check(item, words, [1, 2])
        assert bool(got) == want
        wanted, found = wanted + want, found + bool(got)
    assert wanted == found >= 200


def test_item_without_its_answer_before_a_whole_paraphrase():
    item, gap = np.arange(40), np.arange(1000, 1030)
    words = np.concatenate([item[:35], gap, item[:5], item[11:], gap])
    assert passes_somewhere(item, words)
    share, said, first = decontaminate._check(item, words, [0, 1, 2, 3])
    assert share >= decontaminate.MATCH and said >= decontaminate.ANSWER_MATCH and first >= 35


def plain_cards(run):
    """Spans of digit groups, the longest valid one of each start unless it lies in those before."""
    groups = [(m.start(), m.end()) for m in re.finditer(r"\d+", run)]
    digits, end, n = "".join(c for c in run if c.isdigit()), 0, 0
    ends = list(itertools.accumulate(b - a for a, b in groups))
    new = digits
    for a in [0, *ends[:-1]]:
        valid = [b for b in ends if 13 <= b - a <= 19 and luhn(digits[a:b]) == 0]
        if valid and valid[-1] > end:
            end, n = valid[-1], n + 1
            head = feistel_digits(new[a : end - 1], "card")
            new = new[:a] + head + str(-luhn(head + "0") % 10) + new[end:]
    return put(run, new), n


def test_cards_beside_other_numbers(spark):
    runs = ["4111111111111111 123", "2 4111111111111111", "4111 1111 1111 1111 12", "5 4111-1111-1111-1111 12 27", "4111111111111112 123",
            "378282246310005 4111111111111111 5500005555555559 7", " ".join("1234567890" * 40), "4" * 20]
    rng = np.random.default_rng(6)
    for _ in range(200):
        sizes = rng.integers(1, 17, int(rng.integers(1, 7)))
        runs.append("".join("".join(map(str, rng.integers(0, 10, n))) + str(rng.choice([" ", "-"])) for n in sizes)[:-1])
    docs = spark.createDataFrame([(i, f"a {r}/x") for i, r in enumerate(runs)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.pseudonymised(docs, PSEUDONYM_KEY).collect()}
    for i, run in enumerate(runs):
        if re.search(pii.OTHERS, run):
            continue
        want, n = plain_cards(run)
        assert (got[i].text, got[i].n_replaced) == (f"a {want}/x", n)
    assert all("4111111111111111" not in re.sub(r"\D", "", got[i].text) for i in (0, 1, 2, 3, 5))


def test_number_before_a_date_hides_nothing(spark):
    docs = spark.createDataFrame([(1, "id 4711 2021-03-04 10:22"), (2, "2021-03-04 4111111111111111 123-45-6789")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.pseudonymised(docs, PSEUDONYM_KEY).collect()}
    assert "2021-03-04" not in got[1].text and got[1].text.startswith("id 4711 ") and got[1].n_replaced == 1
    assert got[2].n_replaced == 3 and not any(v in got[2].text for v in ("2021-03-04", "4111111111111111", "123-45-6789"))


def test_secrets_of_any_length(spark):
    rng = np.random.default_rng(8)
    drawn = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-"), n)) for n in (12, 120, 121, 254, 300, 5000)]
    values = [v for n in (300, 5000) for v in ("a" * n, "a" * (n - 1) + "b", "b" + "a" * (n - 1))] + drawn
    docs = spark.createDataFrame([(i, f"token: {v}. end") for i, v in enumerate(values)], "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in pii.pseudonymised(docs, PSEUDONYM_KEY).collect()}
    assert len(set(got.values())) == len(set(values))
    for i, v in enumerate(values):
        new = got[i].removeprefix("token: ").removesuffix(". end")
        assert len(new) == len(v) and re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", new))) == re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", v)))
        assert max((sum(1 for _ in g) for same, g in itertools.groupby(a == b and a not in "_-" for a, b in zip(new, v, strict=True)) if same), default=0) < 8
        if len(v) <= 254:
            assert new == feistel_letters(v, "secret")


# Written down by hand, not made from the operator's patterns: what must not stay, and the text around it.
FORMS = [
    ("hunter2", "password: {}."), ("Abc!defghijklmnop", "password={} x"), ("sk-abc.def123", 'api_key: "{}"'), ("Zm9v+YmFy/cXV4MTIzNA==", "token={}"),
    ("s3cr3t!pw", "'secret': '{}',"), ("020 7946 0958", "call {} now"), ("0171-555-1234", "Tel {}."), ("(555) 123-4567", "at {}"),
    ("555-123-4567", "or {},"), ("+44 20 7946 0958", "{}"), ("04/07/1981", "born {}."), ("4.7.1981", "am {}"), ("12/25/1980", "on {}"), ("1981-07-04", "{}"),
    ("GB82 WEST 1234 5698 7654 32", "IBAN {}"), ("DE89370400440532013000", "({})"), ("FR1420041010050500013M02606", "{} and more"),
    ("123456789", "SSN: {}"), ("123-45-6789", "{}"), ("Jane.Doe@Example.com", "<{}>"), ("10.20.30.40", "{}:80"), ("4111 1111 1111 1111", "DE12 {}"),
]
PLAIN = [
    "password: please", "the secret: nothing at all", "token = next", "GB83 WEST 1234 5698 7654 32", "99/99/2020 and 1/2/3", "section 1.2.3 of 10",
    "page 0123 of 4567", "PART 1234 5678", "ISBN 0-306-40615-2", "in 1981/82", "order 123456789",
]


def test_forms_written_by_hand(spark):
    texts = [around.format(value) for value, around in FORMS] + PLAIN
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.pseudonymised(docs, PSEUDONYM_KEY).collect()}
    for i, (value, around) in enumerate(FORMS):
        assert value not in got[i].text and got[i].n_replaced == 1, (value, got[i])
        before, after = around.split("{}")
        assert got[i].text.startswith(before) and got[i].text.endswith(after)
    assert [got[i].text for i in range(len(FORMS), len(texts))] == PLAIN


def test_equal_values_in_other_spellings_are_linked(spark):
    pairs = [("to A.b@X.com", "to a.B@x.com"), ("4/7/1981", "04/07/1981"), ("token: abcDEF123456", "token: abcDEF123456."), ("ssn 123456789", "ssn 123-45-6789")]
    docs = spark.createDataFrame([(2 * i + j, t) for i, pair in enumerate(pairs) for j, t in enumerate(pair)], "doc_id bigint, text string")
    got = {r.doc_id: r.text.rstrip(".").replace("-", "") for r in pii.pseudonymised(docs, PSEUDONYM_KEY).collect()}
    assert all(got[2 * i] == got[2 * i + 1] for i in range(len(pairs)))
    assert not spark.createDataFrame([("04/07/1981",)], "t string").select(pii.day(F.col("t"), "a") == pii.day(F.col("t"), "b")).first()[0]


def test_notices_inside_long_lines(spark):
    words = sorted({w for d in rows_of(spark, MORE) for w in (d["text"] or "").lower().split() if w.isalpha()})
    rng = np.random.default_rng(2)
    kinds = [(f, t) for f, t in ((f, ts[0]) for f, ts in licenses.TEMPLATES.items())]
    made = []
    for n in (30, 300, 5000):
        for family, notice in kinds:
            around = list(rng.choice(words, n))
            at = int(rng.integers(0, n + 1))
            made.append((len(made) - 1000, " ".join([*around[:at], notice, *around[at:]]), family))
    docs = table(spark, MORE, "documents").select("doc_id", "text")
    fitted = licenses.train(docs)
    rows = spark.createDataFrame([m[:2] for m in made], "doc_id bigint, text string")
    got = {(r.doc_id, r.family) for r in licenses.scan(rows, *fitted).collect()}
    found = [(i, f) in got for i, _, f in made]
    assert sum(found) >= 0.95 * len(found), [sum(found[k : k + len(kinds)]) for k in range(0, len(found), len(kinds))]
    both = spark.createDataFrame([(None, made[-1][1] + " " + made[-len(kinds)][1])], "doc_id bigint, text string")
    assert {r.family for r in licenses.scan(both, *fitted).collect()} == {kinds[0][0], kinds[-1][0]}


# Written as in the files they come from.
NOTICES = {
    "GPL": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
            "GNU GENERAL PUBLIC LICENSE\n\nVersion 3, 29 June 2007"],
    "Apache-2.0": ["SPDX-License-Identifier: Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "MIT": ["The MIT License (MIT)", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "MPL-2.0": ["Mozilla Public License Version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
}


def test_wrapped_notices_titles_and_identifiers(spark):
    import textwrap

    docs = table(spark, MORE, "documents").select("doc_id", "text")
    fitted = licenses.train(docs)
    words = sorted({w for d in rows_of(spark, MORE) for w in (d["text"] or "").lower().split() if w.isalpha()})
    rng = np.random.default_rng(4)
    made = []
    for family, texts in NOTICES.items():
        for text in texts:
            for width in (40, 72, 80):
                for mark in ("", " * ", "# "):
                    lines = [mark + line for piece in text.split("\n") for line in textwrap.wrap(piece, width) or [""]]
                    around = [textwrap.fill(" ".join(rng.choice(words, 60)), width) for _ in range(2)]
                    made.append((len(made), "\n".join([around[0], "", *lines, "", around[1]]), family))
    clean = [(1000 + i, textwrap.fill(" ".join(rng.choice(words, 200)), 72)) for i in range(100)]
    rows = spark.createDataFrame([m[:2] for m in made] + clean, "doc_id bigint, text string")
    got = {(r.doc_id, r.family) for r in licenses.scan(rows, *fitted).collect()}
    missed = [(m[1][-400:], m[2]) for m in made if (m[0], m[2]) not in got]
    assert len(missed) <= 0.05 * len(made), missed
    wrong = [(i, f) for i, f in got if i >= 1000 or made[i][2] != f]
    assert len(wrong) <= 0.05 * len(made), wrong


def test_a_weaker_notice_beside_a_whole_one_stays(spark):
    docs = table(spark, MORE, "documents").select("doc_id", "text")
    fitted = licenses.train(docs)
    weaker = "Licensed under the Apache License, of Version 2.0."
    rows = [(1, weaker), (2, f"{weaker}\nReleased under the MIT License.\n\nshort end"), (3, f"one two\nReleased under the MIT License.\n{weaker}")]
    got = {(r.doc_id, r.line, r.family) for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), *fitted).collect()}
    assert got == {(1, 0, "Apache-2.0"), (2, 0, "Apache-2.0"), (2, 1, "MIT"), (3, 1, "MIT"), (3, 2, "Apache-2.0")}


def test_classifier_learns_from_all_ordinary_lines(spark, monkeypatch):
    monkeypatch.setattr(licenses, "BACKGROUND", 2)
    lines = [f"river{i} stone {'affero' if i % 5 == 0 else 'bridge'} field{i % 7}" for i in range(400)]
    rows = [(i, "\n".join(lines[i : i + 8])) for i in range(0, 400, 4)] + [(1000, None), (None, lines[0]), (1001, "Released under the MIT License.")]
    model, least, templates, marked = licenses.train(spark.createDataFrame(rows, "doc_id bigint, text string"))
    taught = model.summary.predictions.groupBy("label").count().collect()
    taught = {int(r["label"]): r["count"] for r in taught}
    assert 150 <= taught.pop(0) <= 250 and sum(taught.values()) == licenses.DISGUISES * len(templates)
    # Counted over all lines, "affero" is no rare word.
    assert "affero" not in marked and {"agpl", "gnu"} & set(marked)
    # However many ordinary lines there are, each template is still known.
    scored = licenses._vectors(spark.createDataFrame([(r.family, r.terms) for r in templates], "family string, terms array<string>"))
    assert all(licenses.FAMILIES[int(r.prediction)] == r.family for r in model.transform(scored).collect()) and least >= 0.5


def test_lines_kept_to_calibrate_are_stored_without_features(spark, monkeypatch):
    monkeypatch.setattr(licenses, "BACKGROUND", 2)
    monkeypatch.setattr(licenses, "FALSE_SHARE", 0.1)
    stored = {}
    monkeypatch.setattr(licenses, "materialize", lambda df, name, write=licenses.materialize: stored.setdefault(name, write(df, name)))
    lines = [f"river{i} {('affero', 'stone', 'gnu', 'mozilla')[i % 4]} field{i % 7} {('bridge', 'lesser')[i % 3 == 0]} bank{i}" for i in range(600)]
    # Each line comes three times, in other letters and marks, and in rows without an id or of the same id.
    rows = [(i % 50 or None, "\n".join([f"* {a.upper()}!", f"{a}  ", "--", lines[i - 1].replace(" ", ", ")])) for i, a in enumerate(lines)] + [(1, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model, least, templates, _ = licenses.train(docs)
    known = {t for r in templates for t in r.terms}
    ordinary = stored["ordinary"].collect()
    assert len(ordinary) == 600 and 250 <= sum(r.kept for r in ordinary) <= 350
    assert all((r.x.numNonzeros() == 0) == r.kept for r in ordinary)
    # Their words are counted, and their probabilities make the threshold, each line once.
    assert sorted(w for r in ordinary for w in r.held) == sorted(w for a in lines for w in a.split(" ") if w in known)
    plain = spark.createDataFrame([(a, a.split(" ")) for a in lines], "body string, words array<string>").filter("pmod(xxhash64(body), 2) = 1")
    likely = sorted(1 - r.probability[0] for r in model.transform(licenses._vectors(plain.withColumn("terms", licenses.terms_of("words")))).collect())
    assert len(likely) == sum(r.kept for r in ordinary) and likely[-1] > 0.5
    assert least == pytest.approx(max(0.5, likely[int(np.ceil(0.9 * len(likely))) - 1]), abs=1e-12) and least > 0.5


def test_calibrating_lines_alone_have_the_features_of_their_terms(spark):
    lines = ["river", "the the the the", "* ÉTÉ, été--\u00dcber!", "version of the stone 12 12", "under the License of rivers", "gnu", "a1 b2 a1 b2 c3", "\t of ", ""]
    lines += [f"the river{i}  of, license{i % 3} bank{i}" for i in range(40)]
    docs = spark.createDataFrame([(None, "\n".join(lines)), (1, None), (2, lines[0]), (2, lines[4])], "doc_id bigint, text string")
    templates = licenses._templates(docs).collect()
    plain = licenses._plain(docs, templates, "doc_id", "text")
    alone = licenses._plain(docs, templates, "doc_id", "text", kept=True)
    assert sorted(map(str, alone.collect())) == sorted(map(str, plain.filter("kept").collect())) and 10 < alone.count() < 35
    # Of lines that share a pair with a template only those are left out.
    pairs = {t for r in templates for t in r.terms if " " in t}
    bodies = [" ".join(w for w in re.split(r"[\W_]+", a.lower()) if w) for a in [*lines, lines[0], lines[4]]]
    assert sorted(r.body for r in plain.collect()) == sorted(b for b in bodies if b and pairs.isdisjoint(map(" ".join, zip(b.split(), b.split()[1:], strict=False))))
    want = {r.body: r.x for r in licenses._vectors(plain.withColumn("terms", licenses.terms_of("words"))).collect()}
    assert {r.body: r.x for r in licenses._features(plain, "body").collect()} == want
    # A line without a body, as the stored ones kept to calibrate, has no features.
    assert licenses._features(plain.limit(1).withColumn("body", F.lit(None).cast("string"))).first().x.numNonzeros() == 0


def test_threshold_is_exceeded_by_its_share_of_all_lines(spark, monkeypatch):
    docs = table(spark, MORE, "documents").select("doc_id", "text").limit(100)
    model, _, templates, _ = licenses.train(docs)
    kept = licenses._vectors(licenses.paragraphs(licenses.lines_of(docs)).select("terms").unionByName(
        spark.createDataFrame([(list(r.terms)[i:],) for r in templates for i in range(3)], "terms array<string>"))).cache()
    likely = sorted(1 - r.probability[0] for r in model.transform(kept).collect())
    for share in (0.001, 0.05, 0.5):
        monkeypatch.setattr(licenses, "FALSE_SHARE", share)
        want = max(0.5, likely[int(np.ceil((1 - share) * len(likely))) - 1])
        assert licenses._least(model, kept) == pytest.approx(want, abs=1e-12)
    assert licenses._least(model, kept.limit(0)) == 0.5


def test_marks_lose_no_paragraph_that_could_be_confirmed(spark):
    docs = table(spark, MORE, "documents").select("doc_id", "text")
    _, _, templates, marked = licenses.train(docs)
    rng = np.random.default_rng(6)
    for r in templates:
        for _ in range(300):
            kept = [t for t in r.terms if rng.random() < 0.85]
            if len(kept) >= licenses.CONFIRM * len(r.terms):
                assert {w for t in kept for w in t.split(" ")} & set(marked)


def test_leaks_and_tokens_of_documents_without_an_id(spark, tmp_path):
    item = "what is the colour of the quiet river under the old stone bridge near zurvath the answer is deep green"
    rows = [(None, f"well {item} then", "en", "a"), (None, "clean text without id", "en", "a"), (None, "clean text without id", "en", "a"),
            (7, f"so {item} and more", "en", "a"), (7, "a clean text of the same id", "en", None), (8, "one two", "en", "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    kept = decontaminate.keep_clean(docs, items)
    assert kept.columns == docs.columns and sorted(r.text for r in kept.collect()) == sorted(t for _, t, _, _ in rows if item not in t)
    tokenizer = token_files.public_tokenizer("word_bpe_49k.json")
    ledger = token_counts.TokenLedger(spark, f"file://{tmp_path}/ledger")
    counted = token_counts.counted(docs.filter("doc_id is null or doc_id = 8"), tokenizer)
    ledger.commit(1, token_counts.change_rows(counted, "insert", "t"))
    want = {s: (sum(r.source == s for r in counted.collect()), sum(r.n_tokens for r in counted.collect() if r.source == s)) for s in ("a", "b")}
    assert {r.source: (r.documents, r.tokens) for r in ledger.totals().collect()} == want and want["a"][0] == 3
    ledger.commit(2, token_counts.change_rows(counted.filter("n_tokens < 10 and doc_id is null"), "delete", "t"))
    assert {r.source: r.documents for r in ledger.totals().collect()} == {"a": 1, "b": 1}


def test_revising_a_document_without_an_id_is_refused(spark, tmp_path):
    rows = [(None, "first", "a", "en", 4), (5, None, "a", "en", 2)]
    counted = spark.createDataFrame(rows, "doc_id bigint, content string, source string, lang string, n_tokens bigint")
    ledger = token_counts.TokenLedger(spark, f"file://{tmp_path}/ledger")
    ledger.commit(1, token_counts.change_rows(counted, "insert", "t"))
    with pytest.raises(Exception, match="cannot be revised"):
        ledger.commit(2, token_counts.change_rows(counted.withColumn("n_tokens", F.lit(9)), "revise", "t"))
    assert ledger.committed() == [1]
    assert ledger.commit(2, token_counts.change_rows(counted.filter("doc_id = 5").withColumn("n_tokens", F.lit(9)), "revise", "t"))
    assert ledger.commit(3, token_counts.change_rows(counted.limit(0), "insert", "t"))
    assert [tuple(r)[-2:] for r in ledger.totals().collect()] == [(2, 13)]
