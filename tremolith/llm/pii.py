"""Personal data by bootstrapped contextual extraction.

Strict patterns find seed entities of four kinds.  Each seed, and each candidate (a token or number run that looks like an
identifier but matches no strict pattern), is an instance seen in lexical contexts: the word before it, the two words
before, the word after, both sides, each with the instance's form.  Spark keeps the graph of distinct contexts and
instances and scores it in rounds: a context is trusted for a kind by the mean score of its instances (at least
``support`` of them scored), an instance gets the noisy-or of its trusted contexts.  After the rounds, candidates whose
score for a kind reaches ``sure`` become spans of that kind.  Only scores move; no texts are shuffled.

What matches a strict pattern but fails its check (an octet over 255, a wrong check digit) is no candidate: it is known
not to be of the kind.  Added spans never overlap strict ones.

Defined cases: null texts count as empty and have no spans.  Repeated rows count once in the graph, by text and place, and
each gets its spans.  Equal scores for two kinds go to the kind listed first.  Only id and text are read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import text as T
from .stage import stage

# The kinds and patterns of the contract.
KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: What may be an identifier: a token with an at sign, also a written one; a run of six digits or more; a token with as many.
CANDIDATE = re.compile(r"[^\s@]+@[^\s@]+|\S+\s?[\[(]\s?at\s?[\])]\s?\S+|\(?[0-9](?:[ ().-]{0,2}[0-9]){5,}|\S*[0-9]\S*")
_EDGE = "\"'`.,;:!?()[]{}<>"
_SPAN = pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32())])
_SEEN = pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("inst", pa.string()), ("ctx", pa.list_(pa.string()))])
_KIND = pa.struct([("base", pa.list_(_SPAN)), ("seen", pa.list_(_SEEN))])
_DDL = "struct<base:array<struct<k:int,s:int,e:int>>,seen:array<struct<k:int,s:int,e:int,inst:string,ctx:array<string>>>>"


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def strict(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Spans (kind, start, end) by kind and start, and all stretches that match a pattern, valid or not."""
    found, matched, last, at = [], [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and LOCAL.match(text[start - 1]):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            last = m.end()
            found.append((0, start, last))
        at = text.find("@", max(at + 1, last))
    for m in IP.finditer(text):
        matched.append(m.span())
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            found.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if len(digits) >= 12:
            matched.append(m.span())
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    for m in PHONE.finditer(text) if "+" in text else ():
        matched.append(m.span())
        if 8 <= sum(c in "0123456789" for c in m.group()) <= 15:
            found.append((3, *m.span()))
    return found, matched + [(s, e) for _, s, e in found]


def form(value: str) -> str:
    digits, letters = sum(c.isdigit() for c in value), sum(c.isalpha() for c in value)
    return "at" if "@" in value or re.search(r"[\[(]\s?at\s?[\])]", value) else "number" if digits > letters else "mixed"


def contexts(text: str, start: int, end: int) -> list[str]:
    value = text[start:end]
    before = text[max(0, start - 80):start].lower().split()[-2:]
    after = text[end:end + 40].lower().split()[:1]
    f = form(value)
    left, right = before[-1] if before else "^", after[0] if after else "$"
    return [f"{f}|{left}|", f"{f}|{' '.join(before) or '^'}||", f"{f}||{right}", f"{f}|{left}|{right}"]


def _find(texts: T.Texts):
    digits = T.sums(((texts.data >= 0x30) & (texts.data <= 0x39)).astype(np.int64), texts.offsets)
    ats = T.sums((texts.data == 0x40).astype(np.int64), texts.offsets)
    base, seen = [], []
    for i in range(len(texts)):
        raw = texts.bytes_of(i)
        if digits[i] < 4 and not ats[i] and b"at)" not in raw and b"at]" not in raw:
            base.append([])
            seen.append([])
            continue
        text = raw.decode(errors="replace")
        found, taken = strict(text)
        own = [{"k": k, "s": s, "e": e, "inst": text[s:e].lower(), "ctx": contexts(text, s, e)} for k, s, e in found]
        taken.sort()
        for m in CANDIDATE.finditer(text):
            s, e = m.span()
            s += len(m.group()) - len(m.group().lstrip(_EDGE))
            e = s + len(text[s:e].rstrip(_EDGE))
            value = text[s:e]
            if form(value) != "at" and sum(c.isdigit() for c in value) < 6 or any(a < e and s < b for a, b in taken):
                continue
            own.append({"k": -1, "s": s, "e": e, "inst": value.lower(), "ctx": contexts(text, s, e)})
        base.append([{"k": k, "s": s, "e": e} for k, s, e in found])
        seen.append(own)
    return T.struct(base=pa.array(base, pa.list_(_SPAN)), seen=pa.array(seen, pa.list_(_SEEN)))


def discover(seen: DataFrame, rounds: int = 3, support: int = 5, trust: float = 0.8) -> DataFrame:
    """(inst, kind, score) of instances without a kind, from ``seen`` (k, inst, ctx), k = -1 where unknown."""
    edges = stage(seen.select("inst", F.explode("ctx").alias("ctx")).distinct(), "contexts")
    seeds = stage(seen.where("k >= 0").groupBy("inst").agg(F.min("k").alias("kind")).withColumn("score", F.lit(1.0)), "seeds")
    sizes = edges.groupBy("ctx").agg(F.count("*").alias("n"))
    scores = seeds
    for _ in range(rounds):
        good = (edges.join(scores, "inst").groupBy("ctx", "kind").agg(F.sum("score").alias("sum"), F.count("*").alias("scored"))
                .where(F.col("scored") >= support).join(sizes, "ctx").withColumn("conf", F.col("sum") / F.col("n")).where(F.col("conf") >= trust))
        reached = edges.join(good.select("ctx", "kind", "conf"), "ctx").groupBy("inst", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("conf"), F.lit(1e-6)))))).alias("score"))
        new = reached.join(seeds.select("inst"), "inst", "left_anti").groupBy("inst").agg(F.max_by(F.struct("kind", "score"), F.struct("score", -F.col("kind"))).alias("b")).select("inst", "b.kind", "b.score")
        scores = stage(seeds.unionByName(new), "scores")
    return scores.join(seeds.select("inst"), "inst", "left_anti")


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sure: float = 0.9, rounds: int = 3, support: int = 5, trust: float = 0.8) -> DataFrame:
    """doc_id, base and added spans (arrays of struct k, s, e: kind, start, end in code points) of every row."""
    find = T.column_udf(lambda: _find, _KIND, _DDL)
    rows = stage(docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), find(F.col(text)).alias("f")), "personal")
    seen = rows.select("row", F.explode("f.seen").alias("o")).select("row", "o.*")
    found = discover(seen.select("k", "inst", "ctx"), rounds, support, trust).where(F.col("score") >= sure)
    new = seen.where("k < 0").join(found, "inst").groupBy("row").agg(F.collect_set(F.struct(F.col("kind").alias("k"), "s", "e")).alias("added"))
    none = F.array().cast("array<struct<k:int,s:int,e:int>>")
    return rows.join(new, "row", "left").select("doc_id", F.array_sort(F.col("f.base")).alias("base"), F.array_sort(F.coalesce("added", none)).alias("added"))


def written(spans: Column) -> Column:
    """kind:start:end by kind and start, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
