"""Best-fit packing against best fit on single items, and against the tokenizer; word keys against words that break polynomials."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import SF, words
from tremolith.llm import lm_score, near_dedup, packing, text as T, token_output
from tremolith.llm.queries import BYTE_BPE, QUERIES


def thue_morse(n=1024):
    first = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return first, first.translate(str.maketrans("ab", "ba"))


def best_fit(lengths, room):
    """Number of bins of best fit, one item at a time, longest first."""
    rests = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rests if r >= n]
        if fit:
            rests.remove(min(fit))
            rests.append(min(fit) - n)
        else:
            rests.append(room - n)
    return sorted(rests)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit(seed):
    rng = random.Random(seed)
    room = rng.choice([7, 20, 64])
    lengths = [min(room, 1 + int(rng.expovariate(3 / room))) for _ in range(rng.choice([0, 1, 50, 400]))] + [rng.randrange(1, room + 1)] * rng.choice([0, 200])
    rows = packing.plan(Counter(lengths), room)
    used, seen = {}, Counter()
    for length, low, high, first, each, offset in rows:
        assert low == seen[length] and each > 0
        seen[length] = high
        for rank in range(low, high):
            used.setdefault(first + (rank - low) // each, []).append((offset + (rank - low) % each * length, length))
    assert seen == Counter(lengths)
    for items in used.values():
        items.sort()
        assert [a for a, _ in items] == np.cumsum([0] + [n for _, n in items])[:-1].tolist() and sum(n for _, n in items) <= room
    assert sorted(used) == list(range(len(used)))
    assert sorted(room - sum(n for _, n in items) for items in used.values()) == best_fit(lengths, room)
    assert len(rows) <= 6 * room


def check(got, rows, room):
    of = Tokenizer.from_file(BYTE_BPE)
    want = Counter()
    for d, t in rows:
        ids = of.encode(t or "", add_special_tokens=False).ids + [0]
        first = (len(ids) - 1) % room + 1
        cuts = [0, *range(first, len(ids) + 1, room)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= room
    lengths = [r.length for r in got]
    assert len(bins) == len(best_fit(lengths, room)) and len(bins) >= -(-sum(lengths) // room)
    return len(bins)


def test_query(spark):
    got = QUERIES["op12_packing"](spark, SF).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(got, rows, 2048)


@pytest.mark.parametrize("room", [1, 100, 2048])
def test_odd_documents(docs, rows, room):
    if room == 1:
        docs, rows = docs.where("length(text) < 60 or text is null"), [(d, t) for d, t in rows if t is None or len(t) < 60]
    packed = packing.pack(docs.repartition(5), BYTE_BPE, room)
    pieces = packed.pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids").join(packed.slots, ["part", "place"])
    n = check(pieces.collect(), rows, room)
    made = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    assert len(made) == n
    for r in packed.pieces.join(packed.slots, ["part", "place"]).collect():
        own = made[r.sequence_id]
        assert own.ids[4 * r.offset:4 * (r.offset + r.length)] == r.ids
        assert (r.doc_id, r.piece, r.start, r.offset, r.length) in [tuple(p) for p in own.pieces]


def test_no_documents(empty):
    packed = packing.pack(empty, BYTE_BPE)
    assert packed.pieces.count() == packed.slots.count() == packing.sequences(packed).count() == 0


def test_text_ids(spark):
    table = spark.createDataFrame([("b", "x y"), ("a", None), ("a", "x y")], "name string, body string")
    packed = packing.pack(table, BYTE_BPE, doc_id="name", text="body")
    assert sorted(r.doc_id for r in packed.pieces.collect()) == ["a", "a", "b"] and packed.slots.select("sequence_id").distinct().count() == 1


# --- keys of words

def test_keys_follow_words():
    texts = ["Ab  c\tAB", None, "", "é È ab", "x" * 50 + " " + "x" * 49, " lead", "tail "]
    (s,) = T.slices(pa.array(texts))
    w = T.words(s)
    own = dict(zip(w.keys().tolist(), [w.get(i) for i in range(len(w))]))
    assert len(own) == len({x for t in texts for x in words(t)}) and [own[k].decode() for k in w.keys().tolist()] == [x for t in texts for x in words(t)]


def test_keys_of_thue_morse_words_differ():
    pair = thue_morse()
    (s,) = T.slices(pa.array(list(pair)))
    w = T.words(s)
    assert w.hashes()[0] == w.hashes()[1]  # the polynomial is broken
    assert w.keys()[0] != w.keys()[1]


def test_thue_morse_words_stay_apart(spark):
    pair = thue_morse()
    rows = [(1, pair[0]), (2, pair[1]), (3, pair[0])]
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = {r.doc_id: (r.component_id, r.kept) for r in near_dedup.near_duplicates(table, k=3, percent=85).collect()}
    assert found == {1: (1, True), 2: (2, True), 3: (1, False)}
    encode = token_output.Encoder(BYTE_BPE)
    (s,) = T.slices(pa.array(list(pair)))
    ids, counts = encode(s)
    plain = Tokenizer.from_file(BYTE_BPE)
    want = [plain.encode(t, add_special_tokens=False).ids for t in pair]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == want[0] + want[1]
    scored = {r.doc_id: r.n_known for r in lm_score.score(table, F.col("doc_id") != 2).collect()}
    assert scored[2] == 1 and scored[1] == 2  # only the end is known
