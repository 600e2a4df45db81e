"""Personal data: fixed base rules, and identifiers found by bootstrapped contextual extraction.

Base matches seed the method. Each identifier occurs in lexical patterns: its shape (digits as 9), its shape with the
word before or after it, and the words on both sides. Patterns and identifier values form a graph that Spark scores in
rounds: a pattern's confidence for a kind is the share of its distinct values known to be of that kind, and a value that
a confident pattern matches becomes known with that confidence, which lets further patterns be trusted. Values count
once however many copies of a text there are. What the last round knows and the base rules missed (numbers that run
into one another, for instance) is added; base matches always stay.

One pass over the texts gives base matches and candidates; all else works on rows of identifiers.

Candidates are numbers of six or more digits (whole tokens, glued to a label, or runs of spaced tokens) and addresses that the base
pattern doesn't read; only what a trusted pattern matches and its kind's own check allows is added.

Defined results: a null or empty text has no spans; an empty table gives no rows; a text of any length is read whole; null ids and rows that share an id keep their own spans; where
found spans overlap, the more confident, then the longer, then the first stays; extra columns are ignored (redact keeps them,
whatever their names).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep, py_texts

KINDS = ("email", "ip", "card", "phone")
ROUNDS, CONFIDENT, SUPPORT, LEAST_DIGITS = 3, 0.8, 4, 6
#: Digits that an identifier has at most (a card's 19), and so how far a run of tokens is followed.
MOST_DIGITS = 19

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBER = re.compile(r"(?<!\S)[\"'(\[<]*([+(]?[0-9][0-9().+/:-]*[0-9])[\"')\]>.,;:!?]*(?!\S)")
_GLUED = re.compile(r"[:=#/]([0-9][0-9().+/:-]*[0-9])")
_SPACED = re.compile(r"[(0-9][0-9]*[)]?(?:[ -][(]?[0-9]+[)]?)+")
_DOT = re.compile(r" dot |[(\[] ?dot ?[)\]]", re.IGNORECASE)
_ADDRESS = re.compile(r"[^\s@<>()\[\],;:\"']{1,64}(?: ?[(\[] ?at ?[)\]] ?| at |@)[^\s@<>()\[\],;:\"'.]{1,64}(?:(?: ?[(\[] ?dot ?[)\]] ?| dot |\.)[^\s@<>()\[\],;:\"'.]{2,24})+", re.IGNORECASE)
_JOINED = tuple("0123456789.,+(-")
_TOKEN = re.compile(r"[^ ]+")
_NOT_WORD = re.compile(r"[\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]]]:
    """(kind, start, end) by kind, then start; and the matches that were dropped."""
    out, dropped = [], []
    at, free = text.find("@"), 0
    while at >= 0:  # an address is found from its @, so no run of letters is scanned more than once
        local = text[free:at]
        size = len(local) - len(local.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if size else None
        if found:
            out.append(("email", at - size, found.end()))
        free = found.end() if found else at + 1
        at = text.find("@", free)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
        else:
            dropped.append(m.span())
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
        elif len(d) > 19:
            dropped.append(m.span())
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m.group())) <= 15:
            out.append(("phone", *m.span()))
        else:
            dropped.append(m.span())
    return out, dropped


def shape(value: str) -> str:
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]", "9", value))


def _beside(text: str, start: int, end: int) -> tuple[str, str]:
    left, right = text[max(0, start - 48) : start].split(), text[end : end + 48].split()
    words = (left[-1] if left else "^"), (right[0] if right else "$")
    return tuple(_NOT_WORD.sub("", w).lower() or w[:8] for w in words)


def candidates(text: str, base: list[tuple[str, int, int]], dropped: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Places outside base spans that may hold an identifier: numbers of LEAST_DIGITS or more digits (whole tokens, numbers glued
    to a label, runs of tokens up to MOST_DIGITS digits of a dropped match or a spaced number), and addresses that the base
    pattern doesn't read (spelled out, or with letters beyond ASCII)."""
    found = {m.span(1) for m in _NUMBER.finditer(text)} | {m.span(1) for m in _GLUED.finditer(text) if text[m.start() - 1 : m.start()].isalpha()}
    for a, b in {*dropped, *(m.span() for m in _SPACED.finditer(text) if text[m.start() - 1 : m.start()] not in _JOINED)}:
        tokens = [(a + m.start(), a + m.end(), len(_digits(m.group()))) for m in _TOKEN.finditer(text[a:b])]
        for i, (start, _, _) in enumerate(tokens):
            total = 0
            for _, end, n in tokens[i:]:
                total += n
                if total > MOST_DIGITS:
                    break
                found.add((start, end))
    found = {(s, e) for s, e in found if len(_digits(text[s:e])) >= LEAST_DIGITS}
    if "@" in text and not text.isascii() or _DOT.search(text):
        found |= {m.span() for m in _ADDRESS.finditer(text)}
    taken = Apart()
    for _, s, e in base:
        taken.add(s, e)
    return [(s, e) for s, e in sorted(found) if taken.free(s, e)]


class Apart:
    """A set of places in a text, kept as disjoint intervals in order."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def _range(self, start: int, end: int) -> tuple[int, int]:
        return bisect_right(self.ends, start), bisect_left(self.starts, end)

    def free(self, start: int, end: int) -> bool:
        lo, hi = self._range(start, end)
        return lo >= hi

    def add(self, start: int, end: int) -> None:
        lo, hi = self._range(start, end)
        if lo < hi:
            start, end = min(start, self.starts[lo]), max(end, self.ends[hi - 1])
        self.starts[lo:hi], self.ends[lo:hi] = [start], [end]


def plausible(value: str) -> list[str]:
    """The kinds that a value found by its context may be of."""
    d, parts = _digits(value), value.split(".")
    out = ["email"] if _ADDRESS.fullmatch(value) else []
    if len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts):
        out.append("ip")
    if 16 <= len(d) <= 19 and luhn(d):
        out.append("card")
    if 8 <= len(d) <= 15:
        out.append("phone")
    return out


def written(spans: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (order[x[0]], x[1], x[2])))


_ONE = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("value", pa.string()), ("shape", pa.string()), ("l", pa.string()), ("r", pa.string()), ("may", pa.list_(pa.string()))])
_SEEN = "doc_id long, text_key long, seen array<struct<kind:string,start:int,stop:int,value:string,shape:string,l:string,r:string,may:array<string>>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = []
        for text in py_texts(batch.column("text")):
            base, dropped = base_spans(text)
            rows = [(*s, text[s[1] : s[2]]) for s in base] + [(None, a, b, text[a:b]) for a, b in (candidates(text, base, dropped) if text else [])]
            seen.append([dict(zip(_ONE.names, (k, a, b, v, shape(v), *_beside(text, a, b), None if k else plausible(v)), strict=True)) for k, a, b, v in rows])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(seen, pa.list_(_ONE))], ["doc_id", "text_key", "seen"])


def score_graph(seen: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(value, kind, score) of values that confident patterns found. seen: rows (kind, value, shape, l, r), kind null for candidates."""
    values = seen.groupBy("value").agg(F.min("kind").alias("kind"))
    patterns = F.explode(F.array(F.concat_ws(" ", F.lit("S"), "shape"), F.concat_ws(" ", F.lit("L"), "l", "shape"), F.concat_ws(" ", F.lit("R"), "r", "shape"), F.concat_ws(" ", F.lit("B"), "l", F.lit("_"), "r")))
    edges = keep(seen.select("value", patterns.alias("pattern")).distinct())
    known = keep(values.where("kind is not null").select("value", "kind", F.lit(1.0).alias("score")))
    open_values = keep(values.where("kind is null").select("value"))
    size = keep(edges.groupBy("pattern").agg(F.count("*").alias("n")).where(f"n >= {SUPPORT}"))
    found = None
    for _ in range(rounds):
        now = known if found is None else known.union(found)
        hits = edges.join(now, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("s"), F.count("*").alias("m")).where(f"m >= {SUPPORT}")
        trusted = hits.join(size, "pattern").select("pattern", "kind", (F.col("s") / (F.col("n") + 1)).alias("score")).where(f"score >= {CONFIDENT}")
        reached = edges.join(open_values, "value", "left_semi").join(trusted, "pattern")
        found = reached.groupBy("value").agg(F.max(F.struct("score", "kind")).alias("best")).select("value", "best.kind", "best.score")
        found = keep(found)
    return found


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = {"counts": [], "sha": [], "spans": [], "list": []}
        for seen, more in zip(batch.column("seen").to_pylist(), batch.column("more").to_pylist(), strict=True):
            base = [(x["kind"], x["start"], x["stop"]) for x in seen if x["kind"]]
            extra: list[tuple[str, int, int]] = []
            taken = Apart()
            for x in sorted(more or [], key=lambda x: (-x["score"], x["start"] - x["stop"], x["start"])):
                if taken.free(x["start"], x["stop"]):
                    taken.add(x["start"], x["stop"])
                    extra.append((x["kind"], x["start"], x["stop"]))
            rows["counts"].append([sum(k == kind for k, _, _ in base) for kind in KINDS])
            rows["sha"].append(hashlib.sha256(written(base).encode()).hexdigest())
            rows["spans"].append(written(base + extra))
            rows["list"].append(len(extra))
        columns = [batch.column("doc_id"), batch.column("text_key"), *(pa.array([c[i] for c in rows["counts"]], pa.int64()) for i in range(4)), pa.array(rows["sha"], pa.string()), pa.array(rows["spans"], pa.string()), pa.array(rows["list"], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_found"])


def find(documents: DataFrame) -> DataFrame:
    """doc_id, text_key, n_email, n_ip, n_card, n_phone (base matches), base_sha256, spans (all), n_found (added by the method)."""
    text = F.col("text").cast("string")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    scanned = keep(docs.mapInArrow(_scan, _SEEN))
    seen = scanned.select("doc_id", "text_key", F.explode("seen").alias("x")).select("doc_id", "text_key", "x.*")
    found = score_graph(seen.select("kind", "value", "shape", "l", "r"))
    more = seen.where("kind is null").drop("kind").join(found, "value").where("array_contains(may, kind)").groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("kind", "start", "stop", "score")).alias("more"))
    more = more.withColumnRenamed("doc_id", "i").withColumnRenamed("text_key", "t")
    both = scanned.join(more, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("t")), "left").select("doc_id", "text_key", "seen", "more")
    return both.mapInArrow(_merge, "doc_id long, text_key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_found long")


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(-2).to_pylist(), batch.column(-1).to_pylist(), strict=True):
            if text and spans:
                done, parts = 0, []
                for start, end, kind in sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in spans.split(","))):
                    if start >= done:
                        parts += [text[done:start], f"<{kind.upper()}>"]
                    done = max(done, end)
                text = "".join(parts) + text[done:]
            out.append(text)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, pa.string())], [*batch.schema.names[:-2], "text"])


def redact(documents: DataFrame) -> DataFrame:
    """documents with every span replaced by its kind in angle brackets; all columns stay, n_chars (if there) is counted anew."""
    # the input's columns get names of our own, so none can clash
    names = [f"c{i}" for i in range(len(documents.columns))]
    text, ident = (names[documents.columns.index(c)] for c in ("text", "doc_id"))
    docs = documents.toDF(*names)
    spans = find(documents).where("spans <> ''").select(F.col("doc_id").alias("k_id"), F.col("text_key").alias("k_text"), F.col("spans").alias("k_spans")).dropDuplicates(["k_id", "k_text"])
    body = F.col(text).cast("string")
    joined = docs.join(spans, F.col(ident).cast("long").eqNullSafe(F.col("k_id")) & (F.xxhash64(body) == F.col("k_text")), "left")
    rows = joined.select(*(c for c in names if c != text), body.alias("text"), "k_spans")
    schema = T.StructType([*rows.schema.fields[:-2], T.StructField("text", T.StringType())])
    masked = rows.mapInArrow(_mask, schema)

    def column(name: str, held: str) -> Column:
        if name == "n_chars":
            return F.length("text").cast(documents.schema[name].dataType).alias(name)
        return F.col("text" if name == "text" else held).alias(name)

    return masked.select(*(column(n, h) for n, h in zip(documents.columns, names, strict=True)))
