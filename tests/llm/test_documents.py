"""Every document operator against a brute-force version, on real and odd rows."""

import hashlib
import math
import random
import re
import zlib
from array import array
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import SF, lowered, words
from tremolith.llm import decontaminate, fingerprint, langid, lm_score, mixing, near_dedup, pii, text as T, token_output, toxicity
from tremolith.llm.queries import BYTE_BPE, QUERIES, remainder


def test_words_and_hashes():
    texts = ["Ab  c\tAB", None, "", "é È ab", "x" * 50]
    (s,) = T.slices(pa.array(texts))
    w = T.words(s)
    assert [[w.get(i).decode() for i in range(a, b)] for a, b in zip(w.first, w.first[1:])] == [words(t) for t in texts]
    h = w.hashes()
    assert h[0] == h[2] == h[5] and len(set(h.tolist())) == 5 and w.hashes(1)[0] != h[0]
    assert [len(x) for x in T.slices(pa.array(["abc"] * 5), 7)] == [2, 2, 1]


# --- near duplicates

def brute_components(rows, k, percent):
    sets = {}
    for d, t in rows:
        w = words(t)
        sets[d] = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def variants(seed, n, edits):
    """Texts at various distances from one base and from each other: chains and a hub."""
    rng = random.Random(seed)
    base = [f"v{rng.randrange(4000)}" for _ in range(160)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(9999)}"
        out.append(" ".join(w))
        if i % 7 == 0:
            base = w
    return out


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, docs, rows, k, percent):
    more = [(20_000 + i, t) for i, t in enumerate(variants(1, 60, 8) + variants(2, 40, 5))]
    table = docs.select("doc_id", "text", "rep", "key").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    want = brute_components([(d, t) for d, t in rows if d is not None] + more, k, percent)
    got = near_dedup.near_duplicates(table, k=k, percent=percent).collect()
    assert len(got) == len(rows) + len(more)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)
    assert sum(c != d for d, (_, c) in want.items()) > 30


def test_near_duplicates_empty(empty):
    assert near_dedup.near_duplicates(empty).count() == 0


def test_pigeonhole_keys_meet():
    rng = np.random.default_rng(0)
    d = near_dedup.threshold(0.85)
    bounds = np.linspace(0, 64, d // 2 + 2).astype(int)
    for _ in range(200):
        wrong = rng.choice(64, d, replace=False)
        assert np.diff(np.searchsorted(np.sort(wrong), bounds)).min() <= 1


# --- language

def test_language(spark, docs, empty):
    model = langid.train(docs, F.coalesce(remainder(3) != 1, F.lit(False)))
    got = langid.identify(docs, model).select("doc_id", "text", "lang", "n", F.col("language.*")).toDF("doc_id", "text", "lang", "n0", "pred", "score", "entropy", "chars", "rejected").collect()
    known = [r for r in got if r.doc_id is not None and r.doc_id < 9000]
    held = [r for r in known if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(r.pred == r.lang for r in held) >= 0.97 * len(held)
    assert sum(r.rejected for r in known) == 0 and all(0 <= r.score <= 1 for r in got)
    for r in got:
        und = not any(c.isalpha() for c in r.text or "")
        assert (r.pred == "und") == und and (not und or r.rejected)
    junk = spark.createDataFrame([(1, "xqzjkvwq zzqxjvkk qqwxzzvj jkqxvzqw xvqzkjwq zqxwvkjq")], "doc_id long, text string")
    assert langid.identify(junk, model).first().language.rejected
    nothing = langid.train(empty, F.lit(True))
    assert nothing is None and langid.identify(docs, nothing).where("language.lang <> 'und'").count() == 0


def test_language_rejects_despite_labelled_junk(spark, docs):
    """Shuffled and foreign texts go, also when shuffled ones carry a known label; shorter good texts stay."""
    import random
    draw = random.Random(5)
    shuffle = lambda w: "".join(draw.sample(w, len(w)))
    base = [(r.doc_id, r.text, r.lang) for r in docs.where("doc_id < 9000 and lang = 'en'").select("doc_id", "text", "lang").collect()]
    letters = "abcdefghijklmnopqrstuvwxyz"
    noise = lambda n: " ".join("".join(draw.choice(letters) for _ in range(draw.randint(3, 9))) for _ in range(n))
    junk = [(20_000 + i, noise(80), "en") for i in range(12)]
    schema = "doc_id long, text string, lang string"
    model = langid.train(spark.createDataFrame(base + junk, schema), F.lit(True))
    bad = [(1, noise(80), ""), (2, "hyvaa huomenta kaikille tanaan satoi lunta koko paivan ja olimme kotona iltaan asti", "")]
    bad += [(10 + i, " ".join(shuffle(t.replace(" ", ""))[i:i + 6] for i in range(0, 600, 6)), "") for i, (_, t, _) in enumerate([b for b in base if len(b[1]) > 700][:10])]
    good = [(100 + i, " ".join(t.split()[:n]), "") for n in (12, 30, 100) for i, (_, t, _) in enumerate(base[:20])]
    judged = lambda rows: [r.language.rejected for r in langid.identify(spark.createDataFrame(rows, schema), model).collect()]
    assert all(judged(bad)) and not any(judged(good))


def test_language_limits_ignore_outliers():
    """A tenth of junk under a known label moves no limit far; a language without documents kept out has a finite one."""
    good = 1.4 + 0.2 * (np.arange(100) % 10) / 10
    entropy, n = np.concatenate([good, np.full(10, 4.0)]), np.full(110, 500)
    limits = langid.calibrated(["en", "fr"], np.array(["en"] * 110, object), n, entropy)
    assert (limits >= good.max()).all() and (limits < 2.6).all()


def brute_kneser_ney(texts):
    """log p(character | four before it) by dictionaries of strings; words stand alone, between four blanks and one."""
    tables = {5: Counter(("    " + w + " ")[i:i + 5] for t in texts for w in letters(t) for i in range(len(w) + 1))}
    for k in (4, 3, 2, 1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    discount = {}
    for k, own in tables.items():
        n1, n2 = (sum(n == x for n in own.values()) for x in (1, 2))
        discount[k] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / 65536
        after = {g: n for g, n in tables[k].items() if g[:-1] == gram[:-1]}
        if not after:
            return p(gram[1:])
        total, d = sum(after.values()), discount[k]
        return max(after.get(gram, 0) - d, 0) / total + d * len(after) / total * p(gram[1:])
    return lambda word: sum(math.log(p(("    " + word + " ")[i:i + 5])) for i in range(len(word) + 1))


def letters(t):
    return [w for w in re.split("[^a-z]+", t) if w]


def test_kneser_ney_by_dictionaries(spark):
    rng = random.Random(8)
    pools = {"en": ["the", "there", "other", "bother", "mother", "a", "an", "land"], "fr": ["le", "les", "mere", "la", "lande", "entre", "autre"]}
    rows = [(i, " ".join(rng.choices(pools[lang], k=12)), lang) for i, lang in enumerate(["en", "fr"] * 15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fitted = langid._sample(docs, F.lit(True), "doc_id", "text", "lang", 2000, 8_000_000).where("not out").collect()
    assert 10 < len(fitted) < 30
    model = langid.train(docs, F.lit(True))
    probe = ["the", "les", "mothers", "zebra", "t", "entreland"]
    logs, n = model.shared.value.word_logs([w.encode() for w in probe])
    assert n.tolist() == [len(w) + 1 for w in probe] and model.langs == ["en", "fr"]
    for j, lang in enumerate(model.langs):
        brute = brute_kneser_ney([r.t for r in fitted if r.l == lang])
        assert np.allclose(logs[:, j], [brute(w) for w in probe], atol=1e-4)


def test_language_sample_bounds(spark):
    docs = spark.createDataFrame([(i % 40 if i % 3 else 7, "word " * (1 + i % 5), "en") for i in range(300)] + [(None, "never learnt", "en"), (1, None, "en")], "doc_id long, text string, lang string")
    own = lambda *bounds: langid._sample(docs, F.lit(True), "doc_id", "text", "lang", *bounds).collect()
    assert len(own(25, 10**6)) == 25 and len(own(10**6, 10**6)) == 300 and all("never" not in r.t for r in own(10**6, 10**6))
    few = [len(r.t) for r in own(10**6, 200)]
    assert 200 <= sum(few) < 200 + 25  # whole texts until the bound is met


# --- toxicity

def test_toxicity_learns_words_and_stems(spark):
    rng = random.Random(3)
    plain = [f"w{i}a" for i in range(300)]
    rows = []
    for i in range(600):
        w = [rng.choice(plain) for _ in range(rng.randrange(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["vile", "grubby"]) + rng.choice(["", "en", "or", "ta"]))
        rows.append((i, " ".join(w), int(toxic)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(table.select("doc_id", "text"), table.where("doc_id % 5 <> 0").select("doc_id", "toxic"))
    held = toxicity.classify(table, model).where("doc_id % 5 = 0").collect()
    assert sum((r.toxicity >= 0.5) == bool(r.toxic) for r in held) >= 0.95 * len(held)


def test_toxicity_odd_rows(docs, empty, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels)
    got = toxicity.classify(docs, model)
    assert got.count() == docs.count() and got.where("toxicity is null or toxicity < 0 or toxicity > 1").count() == 0 and "rep" in got.columns
    assert toxicity.train(docs, labels.where("false")) is None and toxicity.train(empty, labels) is None
    assert toxicity.classify(docs, None).where("toxicity >= 0.5").count() == 0
    one = toxicity.train(docs, labels.where("toxic = 0"))
    assert toxicity.classify(docs, one).where("toxicity >= 0.5").count() == 0


@pytest.mark.parametrize("shard", [1 << 14, 2000])
def test_toxicity_learns_from_every_label(spark, shard):
    """Words that only some labelled documents hold are learnt, however many others there are, in one shard or in several."""
    rng = random.Random(13)
    plain = [f"w{i}a" for i in range(300)]
    last = {r.id for r in spark.range(0, 8000, 2).orderBy(F.xxhash64(F.col("id").cast("string"), F.lit("sample"))).offset(3000).collect()}
    def text(i):
        w = [rng.choice(plain) for _ in range(rng.randrange(3, 9))]
        return " ".join(w if i % 2 else [*w, "grubby" if i in last else "vile", rng.choice(plain)])
    table = spark.createDataFrame([(i, text(i), 1 - i % 2) for i in range(8000)], "doc_id long, text string, toxic int")
    model = toxicity.train(table.select("doc_id", "text"), table.select("doc_id", "toxic"), **({} if shard == 1 << 14 else {"shard": shard}))
    asked = spark.createDataFrame([(1, "w1a w2a grubby w3a"), (2, "w4a vile w5a"), (3, "w1a w2a w9a w3a"), (4, "w7a w8a")], "doc_id long, text string")
    assert {r.doc_id: r.toxicity >= 0.5 for r in toxicity.classify(asked, model).collect()} == {1: True, 2: True, 3: False, 4: False}


# --- fingerprints

def test_fingerprints(docs, rows):
    got = fingerprint.with_next(docs).withColumn("edited", fingerprint.edited(F.col("text"), F.col("next_text")))
    got = fingerprint.with_fingerprint(fingerprint.with_fingerprint(got, "text", "f"), "edited", "g")
    got = got.withColumn("near", fingerprint.likeness(F.col("f"), F.col("g"))).collect()
    order = sorted(((d, t or "") for d, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert Counter((r.doc_id, r.text, r.next_text) for r in got) == Counter((*a, b[1]) for a, b in zip(order, order[1:] + order[:1]))
    by_text = {}
    for r in got:
        half = len(r.text) // 2
        assert r.edited == r.text[:len(r.text) - half] + r.next_text[:half]
        assert len(r.f) <= 64 * 6 and 0 <= r.near <= 1 and by_text.setdefault(r.text, r.f) == r.f
    assert fingerprint.with_next(docs.where("doc_id = 5")).first().next_text == dict(rows)[5]
    assert fingerprint.with_next(docs.where("false")).count() == 0


def test_fingerprint_follows_order_and_repeats(spark):
    rng = random.Random(5)
    a = [f"t{rng.randrange(10**6)}" for _ in range(400)]
    rows = {"same": a, "one edit": a[:200] + ["new"] + a[201:], "half": a[:200] + [f"u{i}" for i in range(200)], "reversed": a[::-1], "none": [f"q{i}" for i in range(400)], "repeat": a + a, "thrice": a + a + a}
    table = spark.createDataFrame([(n, " ".join(w)) for n, w in rows.items()], "name string, text string")
    table = fingerprint.with_fingerprint(table, "text", "f")
    base = table.where("name = 'same'").first().f
    near = {r.name: r.near for r in table.withColumn("near", fingerprint.likeness(F.col("f"), F.lit(base))).select("name", "near").collect()}
    assert near["same"] == 1 and near["one edit"] > 0.9 and 0.02 < near["half"] < 0.5 and near["none"] == 0 and near["reversed"] < 0.1 and 0 < near["repeat"] < 1
    assert near["thrice"] <= near["repeat"] + 0.1


def brute_tokens(text):
    out = []
    for run in re.findall(r"[^ \t\n\x0b\f\r]+", text):
        if len(run) <= 24 and not re.search("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\ua4cf\uf900-\ufaff\U00020000-\U0003ffff]", run):
            out.append(run)
            continue
        now = ""
        for c in run:
            now += c
            if c in "aeiouAEIOU0123.,:;/&=_()" or c > "\x7f" or len(now) == 32:
                out.append(now)
                now = ""
        out += [now] if now else []
    return out


def brute_fingerprint(text, bins=64, k=2, least=2):
    """Order MinHash by dictionaries, with 64-bit XXH64 hashes chained as Spark chains them."""
    chain = lambda *xs: reduce(lambda h, x: xxhash.xxh64_intdigest((x & (2**64 - 1)).to_bytes(8, "little"), h), xs, 42)
    top = lambda h: (h >> 32) - (2**32 if h >> 63 else 0)
    t = [xxhash.xxh64_intdigest(w.encode(), 42) for w in brute_tokens(text)]
    seen, picked = Counter(), {}
    for i in range(max(len(t) - k + 1, min(len(t), 1))):
        gram = top(chain(*t[i:i + k]))
        n = seen[gram]
        seen[gram] += 1
        low = xxhash.xxh64_intdigest((0).to_bytes(4, "little"), chain(gram)) if n == 0 else xxhash.xxh64_intdigest(n.to_bytes(4, "little"), chain(gram))
        picked.setdefault(((low >> 32) * bins) >> 32, []).append((top(low), i, low >> 32))
    codes = []
    for b, grams in picked.items():
        ordered = sorted(sorted(grams)[:least], key=lambda g: g[1])
        codes.append(f"{b:02x}" + f"{chain(*[g[2] for g in ordered]):016x}"[:4])
    return sorted(codes)


UNSPACED = {"chinese": (0x4E00, 0x5600), "thai": (0xE01, 0xE2E), "code": (0x21, 0x7E), "letters": (0x61, 0x7B)}


def test_fingerprint_by_dictionaries(spark, rows):
    rng = random.Random(17)
    texts = [t or "" for _, t in rows[:60]] + ["", "one", "one two", "x" * 100, "ab " * 50] + ["".join(chr(rng.randrange(*r)) for _ in range(n)) for r in UNSPACED.values() for n in (1, 30, 700)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    for r in fingerprint.with_fingerprint(table, "text", "f").collect():
        assert sorted(re.findall("." * fingerprint.WIDTH, r.f)) == brute_fingerprint(texts[r.i]), texts[r.i]


@pytest.mark.parametrize("script", UNSPACED)
def test_fingerprint_without_blanks(spark, script):
    rng = random.Random(23)
    text = "".join(chr(rng.randrange(*UNSPACED[script])) for _ in range(2000))
    other = "".join(chr(rng.randrange(*UNSPACED[script])) for _ in range(2000))
    table = spark.createDataFrame([("front", text[7] + text), ("middle", text[:1000] + text[3] + text[1000:]), ("gone", text[1:]), ("other", other)], "name string, text string").withColumn("base", F.lit(text))
    table = fingerprint.with_fingerprint(fingerprint.with_fingerprint(table, "text", "f"), "base", "g")
    near = {r.name: r.near for r in table.withColumn("near", fingerprint.likeness(F.col("f"), F.col("g"))).select("name", "near").collect()}
    assert min(near["front"], near["middle"], near["gone"]) > 0.9 and near["other"] < 0.2, near


# --- language-model score

def test_base_score(docs, rows):
    got = lm_score.score(docs, F.coalesce(remainder(7) != 2, F.lit(False))).collect()
    learnt = [t for d, t in rows if d is not None and zlib.crc32(str(d).encode()) % 7 != 2]
    counts = Counter(w for t in learnt for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(d), len(words(t)) + 1, sum(w in counts for w in [*words(t), None]), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*words(t), None]), 4)) for d, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
    assert all(r.train_tokens == n and math.isfinite(r.score) and r.score < 0 for r in got)


def test_model_sums_to_one(docs):
    model, _, _ = lm_score.train(docs.select(F.coalesce("text", F.lit("")).alias("t")))
    for stem in (b"th", b"zq", b""):
        n = len(stem)
        data = np.frombuffer(b"".join(stem + bytes([x]) for x in range(256) if x != 0x20), np.uint8)
        full = model.trie.logs(data, np.full(255, n + 1))
        ends = model.trie.logs(np.frombuffer(stem, np.uint8), np.array([n]))
        # P(stem + byte + end) summed over bytes is at most P(stem + anything), and ends make the rest
        assert (10 ** full).sum() + (10 ** ends).sum() <= 1 + 1e-9


def test_frequent_words_have_contexts(spark):
    """Words that are all frequent: their order decides; contexts beyond the broadcast bound change no score."""
    told = [(i, " ".join(f"red{i % 7} fox runs{i % 5} home{j % 3}" for j in range(12))) for i in range(60)]
    held = [(100, "fox runs1 home2 red3 fox runs4 home0"), (101, "home0 runs4 fox red3 home2 runs1 fox"), (102, "Zebra fox \u00e9"), (103, None)]
    table = spark.createDataFrame(told + held, "doc_id long, text string")
    got = [{r.doc_id: r.score for r in lm_score.score(table, F.col("doc_id") < 100, most=most).collect()} for most in (lm_score.MOST_GRAMS, 300, 0)]
    assert got[0][100] > got[0][101] + 3
    for other in got[1:]:
        assert other.keys() == got[0].keys() and all(abs(other[d] - got[0][d]) < 1e-6 for d in other)


def brute_ppm(learnt, texts):
    """The score by a dictionary of contexts, one byte after another."""
    def stream(t):
        return b" " * lm_score.ORDER + b"".join(w.encode() + b" " for w in words(t)) + b" "
    seen = {}
    for t in learnt:
        s = stream(t)
        for i in range(lm_score.ORDER, len(s)):
            for k in range(lm_score.ORDER + 1):
                seen.setdefault(s[i - k:i], Counter())[s[i]] += 1
    def log(s, i):
        out, gone = 0.0, set()
        for k in range(lm_score.ORDER, -1, -1):
            after = {b: c for b, c in seen.get(s[i - k:i], {}).items() if b not in gone}
            full = sum(after.values())
            if s[i] in after:
                return out + math.log10((2 * after[s[i]] - 1) / (2 * full))
            if after:
                out += math.log10(len(after) / (2 * full))
            gone |= set(seen.get(s[i - k:i], {}))
        return out - math.log10(max(257 - len(gone), 1))
    return [sum(log(s, i) for i in range(lm_score.ORDER, len(s))) for s in map(stream, texts)]


@pytest.mark.parametrize("most", [lm_score.MOST_GRAMS, 500, 0])
def test_every_text_is_spelled_by_contexts(spark, rows, most):
    """Training texts are scored like all others: byte by byte, wherever the contexts lie."""
    texts = [t for _, t in rows[:24]] + [None, "", "one", "one two one", "zqx one"]
    learnt = [t for i, t in enumerate(texts) if i % 4]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm_score.score(table, F.col("doc_id") % 4 != 0, most=most).collect()}
    for i, want in enumerate(brute_ppm(learnt, texts)):
        assert abs(got[i] - want) <= 1e-6 * max(1, abs(want)), (i, got[i], want)


def test_score_without_training(docs, empty):
    got = lm_score.score(docs, F.lit(False)).collect()
    assert len(got) == docs.count() and all(r.n_known == 0 and r.base_score == 0 for r in got)
    assert lm_score.score(empty, F.lit(True)).count() == 0


# --- personal data

def brute_base(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and pii.luhn(digits(s))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15)]
    return [f"{k}:{m.start()}:{m.end()}" for k, rx, ok in kinds for m in re.finditer(rx, t or "") if ok(m.group())]


def test_strict_spans(spark, docs, rows):
    odd = ["a@b@c.de x@y.z@w.v.u ..@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 0000001.2.3.4 1..2", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (2) 345-6789 ++12345678 +1", "é@x.y Ä@é.de me@ho-st.example,", "@" * 50 + "a.b", "9" * 400]
    table = docs.select("doc_id", "text").union(spark.createDataFrame([(50_000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    got = pii.find_personal_data(table).select("doc_id", pii.written(F.col("base")).alias("b")).collect()
    assert sorted((str(r.doc_id), r.b) for r in got) == sorted((str(d), ",".join(brute_base(t))) for d, t in [*rows, *((50_000 + i, t) for i, t in enumerate(odd))])


def test_contexts_discover(spark):
    rows = [(i, f"filler {i} text; hotline +49 30 {1000000 + i * 7919} please, the {i}{i}5551 end") for i in range(30)]
    rows += [(100 + i, f"other words; hotline 030-{7000000 + i} please, the {i}77712{i} end") for i in range(5)]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(5):
        text = dict(rows)[100 + i]
        assert [text[s.s:s.e] for s in got[100 + i].added] == [f"030-{7000000 + i}"] and got[100 + i].added[0].k == 3
    assert not any(got[i].added for i in range(30))


# --- benchmark

def brute_hits(rows, items, n=13):
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = rx.findall(lowered(t))
        k = min(n, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[a:a + k]), set()).add(str(i))
    for d, t in rows:
        w, hit, found = rx.findall(lowered(t)), set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if tuple(w[a:a + k]) in windows:
                    hit.update(range(a, a + k))
                    found |= windows[tuple(w[a:a + k])]
        yield str(d), len(w), len(hit), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block_bytes", [64 << 20, 3000])
def test_decontaminate(spark, docs, rows, block_bytes):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items += [(900, "the"), (901, "of the"), (902, None), (903, " .,! "), (904, "THE the the"), (905, items[0][1]), (906, "one"), (None, "two words")]
    planted = [(60_000, items[3][1].upper().replace(" ", " -- ")), (60_001, "x " + items[5][1] + " y " + items[5][1])]
    table = docs.select("doc_id", "text", "contamination").union(spark.createDataFrame([(*p, "x") for p in planted], "doc_id long, text string, c string"))
    c = F.col("contamination")
    got = decontaminate.decontaminate(table, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes).select("doc_id", c["n_words"], c["n_hit"], F.array_join(c["items"], ","), decontaminate.contaminated()).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(brute_hits([*rows, *planted], items))


def test_decontaminate_empty(spark, docs, empty):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.where("false")).where("contamination.n_hit > 0").count() == 0


# --- mixing

def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, out, rest = 1.5 * sum(sizes.values()), {}, set(names)
    while rest:
        total = sum(w[s] for s in rest)
        over = [s for s in rest if left * w[s] / total > 2 * sizes[s]]
        if not over:
            return out | {s: left * w[s] / total for s in rest}
        for s in over:
            out[s] = 2.0 * sizes[s]
            rest.discard(s)
        left = 1.5 * sum(sizes.values()) - sum(out.values())
    return out


def test_mixing(docs, rows):
    made = mixing.mix_sources(docs, block=16)
    got = made.taken.collect()
    source = [(r.doc_id, r.source, r.text) for r in docs.select("doc_id", "source", "text").collect()]
    sizes = {}
    for _, s, t in source:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = brute_targets(sizes)
    assert len(got) == len(source) and all(0 <= r.taken <= 2 * r.size for r in got)
    assert Counter((str(d), len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), sizes[s], round(want[s], 6)) for d, s, t in source) == Counter((str(r.doc_id), r.size, r.source_size, round(r.target, 6)) for r in got)
    taken = {}
    for r in made.taken.join(made.rows.select("row", "source"), "row").collect():
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= max(0.03 * want[s], 32) for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs, block=16).taken.collect()))
    slots = made.slots.collect()
    assert len({(s.shard, s.place) for s in slots}) == len(slots) and max(Counter((s.sk, s.block) for s in slots).values()) <= 2
    per_slot = {(r.shard, r.place): r.n for r in mixing.shards(made).groupBy("shard", "place").agg(F.sum("n").alias("n")).collect()}
    assert len(per_slot) == len(slots) and max(per_slot.values()) == 16


def test_mixing_empty(empty, docs):
    assert mixing.mix_sources(empty).taken.count() == 0
    assert mixing.mix_sources(docs.where("text is null or trim(text) = ''")).taken.agg(F.sum("taken")).first()[0] == 0


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_permutation(spark, n):
    p = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit("s"), F.lit(3)).alias("p")).collect()
    assert sorted(r.p for r in p) == list(range(n))


# --- tokens

def test_token_files(spark, docs, rows, tmp_path):
    from tokenizers import Tokenizer
    own = Tokenizer.from_file(BYTE_BPE)
    for bits in (True, False):
        path = f"{tmp_path}/{bits}"
        token_output.write(docs, path, BYTE_BPE, block=1000, bits=bits)
        got = token_output.read_documents(spark, path).collect()
        assert len(got) == len(rows)
        want = Counter()
        for d, t in rows:
            ids = own.encode(t or "", add_special_tokens=False).ids + [0]
            want[(str(d), len(ids), zlib.crc32(array("I", ids).tobytes()))] += 1
        assert Counter((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want
        by_start = sorted(got, key=lambda r: r.start)
        assert [r.start for r in by_start] == [0, *np.cumsum([r.n_tokens for r in by_start])[:-1].tolist()]
        assert [r.doc_id or -1 for r in by_start] == sorted(r.doc_id or -1 for r in got)
        index = spark.read.parquet(f"{path}/index").collect()
        assert all(sum(d.len for d in r.docs) == r.n_ids and len(r.plane_bytes) == (32 if bits else 4) for r in index)
    token_output.write(docs.where("false"), f"{tmp_path}/none", BYTE_BPE)
    assert token_output.read_documents(spark, f"{tmp_path}/none").count() == 0


def test_pieces_encode_like_whole_texts():
    from tokenizers import Tokenizer
    own, encode = Tokenizer.from_file(BYTE_BPE), token_output.Encoder(BYTE_BPE)
    rng = random.Random(11)
    parts = ["a", "the", " ", "  ", "\n", "\t", ".", ",", "'s", "'", "é", "…", "日", "9", "x1", "\u00a0", "\u2003", "\x1c", "<|endoftext|>", "<|", "-", "\r\n", "\u0301", "٣"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(4000)]
    (s,) = T.slices(pa.array(texts))
    ids, n = encode(s)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [own.encode(t, add_special_tokens=False).ids for t in texts]


def test_planes_and_crc():
    ids = np.random.default_rng(1).integers(0, 1 << 32, 1003, dtype=np.uint32)
    for bits in (True, False):
        assert (token_output.unshuffle(token_output.shuffle(ids, bits), len(ids)) == ids).all()
    raw = ids.tobytes()
    assert token_output.crc_of_parts([(zlib.crc32(raw[:7]), 7), (zlib.crc32(raw[7:100]), 93), (zlib.crc32(raw[100:]), len(raw) - 100)]) == zlib.crc32(raw)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
