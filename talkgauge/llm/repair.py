"""Conversation structure repair by a suffix-shared automaton.

A conversation is spelled as a word, one letter per row: the initial of its role (``s u a``, ``o`` for others), a capital
if its text is truncated, ``x`` if the row must go.  What the rest of a conversation costs depends on this rest alone, so
equal ends of words are one node of the automaton.  Distinct words are range-partitioned and sorted from their ends, so
words that share an end follow each other: a task keeps the path of the last word, drops the nodes that the next word does
not share and adds its own.  Each node gets, for each of the four grammar states, its cost to go and the first letter of
the best audit suffix; the rest of the suffix is found by following the nodes.  A word is repaired once, however many
conversations spell it.

Rows of a conversation stream through one task in order, since a repaired conversation is sequential; memory is one letter
a row and, in the automaton, 36 bytes for each row of the longest word.

Defined results: rows are ordered by turn (null first), then role, then digest of the text; a null role or text is one
space, a null conversation id is a conversation; of equal rows all but the first are duplicates; an empty table gives no
conversation; other columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgauge.session import materialize

BLANKS = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
LEGAL = {"su", "ua", "au"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, AFTER_S, AFTER_U, AFTER_A = range(4)
# The role that the grammar (s?(ua)+)? asks for in each state, apart from a first system row, and the state it leads to.
WANTED = ("u", "u", "a", "u")
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
ROLES = {"u": "user", "a": "assistant"}
_NEVER = 1 << 60


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, role, text`` with faults put in by the checksum of id and turn: the input that tests and queries repair."""
    spoken = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn, role, text)]
    lot = F.crc32(F.concat(spoken[0], F.lit(":"), spoken[1]).cast("binary")) % 20
    drawn = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), spoken[2].alias("role"), spoken[3].alias("text"), lot.alias("lot"))
    body = F.when(F.col("lot") == 1, F.lit("")).when(F.col("lot") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("lot") == 0, 0).when(F.col("lot") == 3, 2).otherwise(1)
    return drawn.select("conv_id", "turn", F.when(F.col("lot") == 4, "user").otherwise(F.col("role")).alias("role"), body.alias("text"),
                        F.explode(F.array_repeat(F.lit(1), times)).alias("copy")).drop("copy")


def _named(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    said = F.coalesce(F.col(text).cast("string"), F.lit(" "))
    return rows.select(F.col(conv).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
                       said.alias("text"), F.unhex(F.sha2(said, 256)).alias("digest"))


def _in_order(rows: DataFrame, *first: str | Column) -> DataFrame:
    return rows.sortWithinPartitions("conv_id", *first, F.col("turn").asc_nulls_first(), "role", "digest")


def signatures(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation its ``signature`` and the counts ``gaps, blank, duplicate, truncated, illegal``; no text is shuffled."""
    named = _named(rows, conv, turn, role, text)
    kept = F.rtrim(F.col("text"), F.lit(BLANKS))
    open_end = F.when(F.length(kept) == 0, "b").when(~F.right(kept, F.lit(1)).isin(*ENDS), "t").otherwise("")
    dealt = named.select("conv_id", "turn", "role", "digest", open_end.alias("end")).repartition("conv_id")
    # Hash partitions of the conversation hold for the finer window too, so there is one shuffle.
    again = F.row_number().over(W.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first())) > 1
    initial = F.substring("role", 1, 1)
    marked = dealt.withColumn("again", again)
    fault = F.when(F.col("end") == "b", "b").when(F.col("again"), "d").otherwise(F.col("end"))
    spelled = _in_order(marked).select("conv_id", "turn", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"), fault.alias("fault"))
    schema = T.StructType([spelled.schema["conv_id"], *T.StructType.fromDDL(
        "signature string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint")])
    return spelled.mapInArrow(_spell, schema)


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind, now, word, done = None, object(), bytearray(), []
    counts, pairs, turns, low, high, last = {}, 0, 0, None, None, ""

    def close() -> None:
        if word:
            gaps = high - low + 1 - turns if turns else 0
            done.append((now, word.decode(), gaps, counts.get("b", 0), counts.get("d", 0), counts.get("t", 0), pairs))

    def out() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * 7
        arrays = [pa.array(c, k) for c, k in zip(columns, [kind, pa.string(), *[pa.int64()] * 5], strict=True)]
        done.clear()
        return pa.RecordBatch.from_arrays(arrays, ["conv_id", "signature", "gaps", "blank", "duplicate", "truncated", "illegal"])

    for batch in batches:
        kind = batch.column("conv_id").type
        for conv, turn, initial, fault in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault")], strict=True):
            if not word or conv != now:
                close()
                now, word, counts, pairs, turns, low, high, last = conv, bytearray(), {}, 0, 0, None, None, ""
            if last and last + initial not in LEGAL:
                pairs += 1
            last = initial
            counts[fault] = counts.get(fault, 0) + 1
            word += (b"x" if fault in ("b", "d") else initial.upper().encode() if fault == "t" else initial.encode())
            # Turns come in order, so a new one differs from the highest so far.
            if turn is not None and turn != high:
                low, high, turns = turn if low is None else low, turn, turns + 1
        yield out()
    if kind is not None:
        close()
        yield out()


class SuffixPath:
    """Nodes from the end of words up to the start of the last one: costs to go and first letters for the four states."""

    def __init__(self):
        self.spelled = ""
        self.costs = array("q", [0, 2 * INSERT, INSERT, 0])
        self.letters = bytearray(b"$II$")
        self.computed = 1

    def _node(self, symbol: str) -> None:
        child = self.costs[-4:]
        role, worn = symbol.lower(), TRUNCATED if symbol.isupper() else 0
        best = []
        for state in range(4):
            ways = [(DELETE + child[state], "D")]
            if role != "x":
                ways.append((REROLE + worn + child[NEXT[state]], "R"))
                if role == WANTED[state]:
                    ways.append((KEEP + worn + child[NEXT[state]], "K"))
                elif role == "s" and state == START:
                    ways.append((KEEP + worn + child[AFTER_S], "K"))
            best.append(min(ways))
        # Inserted rows lead to other states of the same node; three in turn pass every state.
        for _ in range(3):
            best = [min(best[state], (INSERT + best[NEXT[state]][0], "I")) for state in range(4)]
        self.costs.extend(c for c, _ in best)
        self.letters.extend("".join(x for _, x in best).encode())
        self.computed += 1

    def repair(self, reversed_word: str) -> tuple[int, str]:
        """Cost and audit of a word given from its end; nodes shared with the word before are not computed again."""
        shared = 0
        for a, b in zip(self.spelled, reversed_word, strict=False):
            if a != b:
                break
            shared += 1
        del self.costs[4 * (shared + 1) :], self.letters[4 * (shared + 1) :]
        for symbol in reversed_word[shared:]:
            self._node(symbol)
        self.spelled = reversed_word
        audit, depth, state = bytearray(), len(reversed_word), START
        while (letter := self.letters[4 * depth + state]) != ord("$"):
            audit.append(letter)
            if letter != ord("I"):
                depth -= 1
            if letter != ord("D"):
                first = letter == ord("K") and state == START and reversed_word[depth] in "sS"
                state = AFTER_S if first else NEXT[state]
        return self.costs[4 * len(reversed_word)], audit.decode()


def repairs(words: DataFrame) -> DataFrame:
    """``signature, cost, audit`` of each distinct ``signature``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = SuffixPath()
        for batch in batches:
            found = [path.repair(w) for w in batch.column("back").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("signature"), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())],
                ["signature", "cost", "audit"])

    backwards = words.select("signature").distinct().select("signature", F.reverse("signature").alias("back"))
    return backwards.repartitionByRange("back").sortWithinPartitions("back").mapInArrow(work, "signature string, cost bigint, audit string")


def plans(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation its signature, counts, cost and audit, as a written table."""
    spelled = materialize(signatures(rows, conv, turn, role, text), "signatures")
    return materialize(spelled.join(repairs(spelled), "signature"), "repairs")


def repaired_turns(rows: DataFrame, planned: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, place, edit, role, text`` of the repaired conversations, each whole and in order within a partition."""
    named = _named(rows, conv, turn, role, text).withColumn("seq", F.lit(1))
    none = F.lit(None)
    heads = planned.select("conv_id", none.cast("bigint").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"),
                           none.cast("binary").alias("digest"), F.lit(0).alias("seq"))
    dealt = _in_order(heads.unionByName(named).repartition("conv_id"), "seq").select("conv_id", "role", "text", "seq")
    schema = T.StructType([dealt.schema["conv_id"], *T.StructType.fromDDL("place bigint, edit string, role string, text string")])
    return dealt.mapInArrow(_edit, schema)


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind, now, audit, at, state, place, done = None, None, "", 0, START, 0, []

    def put(edit: str, role: str, text: str) -> None:
        nonlocal state, place
        first = edit == "K" and state == START and role[:1] == "s"
        state = AFTER_S if first else NEXT[state]
        done.append((now, place, edit, role, text))
        place += 1

    def inserted() -> None:
        nonlocal at
        while audit[at : at + 1] == "I":
            at += 1
            put("I", ROLES[WANTED[state]], "")

    def out() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * 5
        kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string()]
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "place", "edit", "role", "text"])

    for batch in batches:
        kind = batch.column("conv_id").type
        for conv, role, text, seq in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "seq")], strict=True):
            if not seq:
                inserted()
                now, audit, at, state, place = conv, text, 0, START, 0
                continue
            inserted()
            edit, at = audit[at], at + 1
            if edit != "D":
                put(edit, role if edit == "K" else ROLES[WANTED[state]], text)
        yield out()
    if kind is not None:
        inserted()
        yield out()


def digests(turns: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of repaired turns that lie whole and in order within partitions."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, now, state, done = None, None, None, []

        def out() -> pa.RecordBatch:
            ids, hexes = [c for c, _ in done], [h for _, h in done]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(hexes, pa.string())], ["conv_id", "repaired_sha256"])

        for batch in batches:
            kind = batch.column("conv_id").type
            for conv, place, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text")], strict=True):
                if place == 0:
                    if state:
                        done.append((now, state.hexdigest()))
                    now, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield out()
        if state:
            done.append((now, state.hexdigest()))
            yield out()

    return turns.mapInArrow(work, T.StructType([turns.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())]))
