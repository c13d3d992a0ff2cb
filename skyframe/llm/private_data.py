"""Personal data and the terms that reveal it: information-theoretic sanitisation.

Patterns find the entities: mail addresses, network addresses, card and phone
numbers.  Their values are protected.  A term is a run of letters, digits and
underscores in lower case; the terms within ``WINDOW`` terms of a mention stand
in its context.  Over all N documents, with D(.) the number of documents that
hold something,

    PMI(e; t) = log2(N * D(t in a context of e) / (D(e) * D(t)))

is what term t tells of entity e, and IC(e) = log2(N / D(e)) all there is to
tell.  What stands for an entity in a sanitised text is its kind g(e), which
tells IC(g(e)).  A term discloses e where it tells as much as g(e) does, and at
least ``SHARE`` of IC(e); at ``ALL`` of it or more it is removed, else
generalised to its own kind.  At least ``SUPPORT`` contexts with different
words are needed, as any rare word tells all of what it meets once.  Such terms
are found wherever they stand in a context of their entity.

One scan finds mentions, contexts and their pairs; pairs are counted in two
steps, so that no hot entity or term meets in one task.  A second scan counts
documents by term, for terms that may disclose something only: a bitmap of
``BITS`` bits, whatever the input, tells it which; what it lets through in error
costs work and changes no result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import stored, text_batches

KINDS = ("email", "ip", "card", "phone")
WINDOW = 10
SUPPORT = 3
SHARE = 0.75
ALL = 0.9
BITS = 1 << 26
#: Distinct terms a scanning task counts before it hands them on.
HELD = 200_000

_TERM = re.compile(r"\w+")
#: What follows a mail's local part. Searching from the sign backwards makes one pass of it, also on endless words.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match can only start with a whole run of digits, as each ends with one.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


# --- entities --------------------------------------------------------------
def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def passes_luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    last = 0
    for m in _DOMAIN.finditer(text):
        start = at = m.start()
        while start > last and text[start - 1] in _LOCAL_LETTERS:
            start -= 1
        if start < at:
            last = m.end()
            yield start, last


def _ips(text: str):
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            yield m.span()


def _cards(text: str):
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 16 <= len(digits) <= 19 and passes_luhn(digits):
            yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            yield m.span()


def entities(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind and start, in code points; matches of a kind don't overlap, those of several may."""
    found = [("email", *s) for s in _emails(text)] if "@" in text else []
    found += [("ip", *s) for s in _ips(text)] + [("card", *s) for s in _cards(text)]
    return found + ([("phone", *s) for s in _phones(text)] if "+" in text else [])


def value_of(kind: str, text: str) -> str:
    """What is protected: the one form of all ways to write it."""
    if kind == "email":
        return text.lower()
    if kind == "ip":
        return ".".join(x.lstrip("0") or "0" for x in text.split("."))
    return _digits(text)


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


# --- first scan ------------------------------------------------------------
def contexts(text: str, window: int = WINDOW) -> tuple[list, list]:
    """The entities of a text, and for each (value, kind, terms around it as (term, start, end))."""
    spans = entities(text)
    if not spans:
        return [], []
    covered, last = [], 0
    for start, end in sorted((s, e) for _, s, e in spans):  # what patterns found is no term
        if end > last:
            covered.append((max(start, last), end))
            last = end
    free, at = [], 0
    for start, end in [*covered, (len(text), len(text))]:
        free += [(m.start() + at, m.end() + at) for m in _TERM.finditer(text[at:start])]
        at = end
    starts = np.array([s for s, _ in free], np.int64)
    out = []
    for kind, start, end in spans:
        before, after = np.searchsorted(starts, (start, end)).tolist()
        around = free[max(0, before - window) : after + window]
        out.append((_hash(kind, value_of(kind, text[start:end])), kind, [(_hash(text[s:e].lower()), s, e) for s, e in around]))
    return spans, out


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_PAIR = pa.struct([("entity", pa.int64()), ("kind", pa.string()), ("term", pa.int64()), ("context", pa.int64())])
_PLACE = pa.struct([("entity", pa.int64()), ("term", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])
_FOUND = (
    "doc_id long, text_key binary, base array<struct<kind: string, start: int, end: int>>, entities array<long>, kinds array<string>, terms array<long>, "
    "pairs array<struct<entity: long, kind: string, term: long, context: long>>, places array<struct<entity: long, term: long, start: int, end: int>>"
)


def text_key(text: str | None) -> bytes:
    return hashlib.md5((text or "").encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


def _found(window: int):
    """A row for each of (doc_id, text); only the key and empty lists where nothing is found."""

    def found(batches):
        for batch in batches:
            for start, texts in text_batches(batch, "text"):
                rows = []
                for t in texts:
                    base, around = contexts(t or "", window)
                    pairs: dict[tuple, int] = {}
                    for e, kind, terms in around:
                        own = _hash(*sorted({str(t) for t, _, _ in terms}))
                        for term, _, _ in terms:
                            pairs[e, kind, term] = min(own, pairs.get((e, kind, term), own))
                    places = sorted({(e, term, s, end) for e, _, terms in around for term, s, end in terms})
                    rows.append((base, {e for e, _, _ in around}, {k for _, k, _ in around}, {t for _, _, t in pairs}, [(*k, v) for k, v in pairs.items()], places))
                base, held, kinds, terms, pairs, places = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, len(texts)),
                        pa.array([text_key(t) for t in texts], pa.binary()),
                        _structs(base, _SPAN),
                        *(pa.array([sorted(x) for x in column], pa.list_(own)) for column, own in ((held, pa.int64()), (kinds, pa.string()), (terms, pa.int64()))),
                        _structs(pairs, _PAIR),
                        _structs(places, _PLACE),
                    ],
                    names=["doc_id", "text_key", "base", "entities", "kinds", "terms", "pairs", "places"],
                )

    return found


def _structs(rows, kind: pa.DataType) -> pa.Array:
    names = [f.name for f in kind]
    return pa.array([[dict(zip(names, x, strict=True)) for x in row] for row in rows], pa.list_(kind))


def mentions(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Entities, contexts and pairs of each row of ``docs``, without texts. A null text is empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_found(window), _FOUND)


# --- second scan -----------------------------------------------------------
def _bit(term: Column) -> Column:
    return F.pmod(term, F.lit(BITS))


def _bitmap(terms: DataFrame) -> np.ndarray:
    """A bit for each of (term); at most BITS / 64 numbers reach the driver."""
    words = terms.select(_bit(F.col("term")).alias("bit")).select(F.shiftright("bit", 6).alias("word"), (F.col("bit") % 64).cast("int").alias("at"))
    words = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("bits"))
    out = np.zeros(BITS // 64, np.int64)
    held = words.toArrow()
    out[held.column("word").to_numpy()] = held.column("bits").to_numpy()
    return out.view(np.uint64)


def _counted(bitmap):
    """(term, n): how many of the texts hold a term, by task and for terms of the bitmap only."""

    def known(word: str) -> int | None:
        term = _hash(word)
        bit = term % BITS
        return term if int(bitmap.value[bit >> 6]) >> (bit & 63) & 1 else None

    def out(n: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64())], names=["term", "n"])

    def counted(batches):
        n: Counter = Counter()
        for batch in batches:
            for _, texts in text_batches(batch, "text"):
                every: Counter = Counter()
                for t in texts:
                    every.update({w.lower() for w in set(_TERM.findall(t))})
                for word, k in every.items():
                    term = known(word)
                    if term is not None:
                        n[term] += k
                if len(n) >= HELD:
                    yield out(n)
                    n = Counter()
        yield out(n)

    return counted


def document_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): how many rows of ``docs`` hold each of (term), and perhaps some other terms."""
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(terms))
    n = docs.select(F.col("text").cast("string").alias("text")).where("text is not null").mapInArrow(_counted(bitmap), "term long, n long")
    return n.groupBy("term").agg(F.sum("n").alias("n_term"))


# --- disclosure ------------------------------------------------------------
def _tells(n: Column, both: Column, entity: Column, term: Column, kind: Column, share: float) -> Column:
    pmi, all_there_is = F.log2(n * both / (entity * term)), F.log2(n / entity)
    return (entity < n) & (n * both / (entity * term) >= n / kind) & (pmi >= share * all_there_is)


def disclosing_terms(docs: DataFrame, found: DataFrame, share: float = SHARE, removed: float = ALL, support: int = SUPPORT) -> DataFrame:
    """(entity, term, action): pairs whose term discloses the entity; action is 'remove' or 'generalise'.

    ``found``: the stored ``mentions`` of ``docs``.
    """
    n = F.lit(float(found.count()))
    pairs = found.select(F.inline("pairs")).groupBy("entity", "kind", "term", "context").agg(F.count("*").alias("n"))
    pairs = pairs.groupBy("entity", "kind", "term").agg(F.sum("n").alias("n_pair"), F.count("*").alias("contexts")).where(F.col("contexts") >= support)

    def held(column: str, name: str) -> DataFrame:
        return found.select(F.explode(column).alias(name)).groupBy(name).agg(F.count("*").alias(f"n_{name}"))

    pairs = pairs.join(held("entities", "entity"), "entity").join(held("kinds", "kind"), "kind")
    counts = [F.col(f"n_{x}").cast("double") for x in ("pair", "entity", "term", "kind")]
    least = held("terms", "term")  # fewer documents than hold the term, so what it tells is less than this
    pairs = pairs.join(least, "term").where(_tells(n, *counts, share)).drop("n_term")
    pairs = stored(pairs, "pairs")
    if pairs.isEmpty():
        return pairs.select("entity", "term", F.lit("remove").alias("action"))
    pairs = pairs.join(document_counts(docs, pairs.select("term").distinct()), "term").where(_tells(n, *counts, share))
    return pairs.select("entity", "term", F.when(_tells(n, *counts, removed), "remove").otherwise("generalise").alias("action"))


def personal_spans(docs: DataFrame, window: int = WINDOW, share: float = SHARE, removed: float = ALL, support: int = SUPPORT) -> DataFrame:
    """(doc_id, text_key, base, terms) for each row of ``docs``: the spans of its entities and of the terms that disclose them.

    base: (kind, start, end) by kind in the order of ``KINDS``, then start;
    terms: (action, start, end) by start, in code points.  A null text is empty,
    rows that repeat an id are documents each, and an empty table gives no rows.
    """
    found = stored(mentions(docs, window), "mentions")
    told = stored(disclosing_terms(docs, found, share, removed, support), "told")
    places = found.select("text_key", F.inline("places")).distinct().join(told, ["entity", "term"])
    places = places.groupBy("text_key", "start", "end").agg(F.max("action").alias("action"))  # 'remove' is the greater
    terms = places.groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("start", "end", "action"))).alias("terms"))  # of one text
    rows = found.select("doc_id", "text_key", "base").join(terms, "text_key", "left")
    none = F.array().cast("array<struct<start: int, end: int, action: string>>")
    return rows.select("doc_id", "text_key", "base", F.coalesce("terms", none).alias("terms"))


def span_digests(spans: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms) of ``personal_spans``; terms are spans of the kind term."""

    def written(kind: Column, s: Column) -> Column:
        return F.concat_ws(":", kind, s["start"].cast("string"), s["end"].cast("string"))

    base = F.transform("base", lambda s: written(s["kind"], s))
    terms = F.transform("terms", lambda s: written(F.lit("term"), s))
    counts = [F.size(F.array_remove(F.col("base.kind"), other)).cast("long") for other in KINDS]
    counts = [(F.size("base") - n).alias(f"n_{kind}") for kind, n in zip(KINDS, counts, strict=True)]
    digest = F.sha2(F.array_join(base, ","), 256)
    return spans.select("doc_id", *counts, digest.alias("base_sha256"), F.array_join(F.concat(base, terms), ",").alias("spans"), F.size("terms").cast("long").alias("n_terms"))


# --- texts -----------------------------------------------------------------
def _kind_of(term: str) -> str:
    return "[NUMBER]" if term.isdigit() else "[NAME]" if term[:1].isupper() else "[TERM]"


def sanitise(text: str, base: list, terms: list) -> str:
    """The text with entities replaced by their kind, and disclosing terms by theirs or by nothing."""
    cuts = sorted([(s, e, f"[{k.upper()}]") for k, s, e in base] + [(s, e, "" if action == "remove" else _kind_of(text[s:e])) for s, e, action in terms])
    out, at = [], 0
    for start, end, put in cuts:
        if start >= at:
            out += [text[at:start], put]
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` with sanitised texts, other columns as they are; null texts stay null. ``limits`` as for ``personal_spans``.

    Texts with entities are joined to their spans by their digest, each once however often it is copied.
    """
    spans = personal_spans(docs, **limits).where("size(base) > 0").groupBy("text_key")
    spans = spans.agg(F.any_value("base").alias("base"), F.any_value("terms").alias("terms"))  # both follow from the text
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("row"), F.unhex(F.md5("text")).alias("text_key")).join(spans, "text_key", "left").select("row", "base", "terms")

    def cleaned(batches):
        for batch in batches:
            columns = dict(zip(names, batch.column("row").flatten(), strict=True))
            texts, base, terms = columns["text"].to_pylist(), batch.column("base").to_pylist(), batch.column("terms").to_pylist()
            new = [t if not b else sanitise(t, [tuple(x.values()) for x in b], [tuple(x.values()) for x in o]) for t, b, o in zip(texts, base, terms, strict=True)]
            columns["text"] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return rows.mapInArrow(cleaned, docs.schema)

