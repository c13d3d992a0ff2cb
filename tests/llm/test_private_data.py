"""Personal data against patterns applied as they are written, and disclosing terms against counts document by document."""

import hashlib
import math
import random
import re

import pytest

from skyframe.llm.private_data import ALL, KINDS, SHARE, SUPPORT, WINDOW, entities, mentions, personal_spans, sanitise, sanitised, span_digests, value_of

R = random.Random(17)
DOCS = "doc_id long, text string, lang string, base string, terms string, _base int"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0


def by_pattern(text):
    out = []
    for kind in KINDS:
        for m in re.finditer(PATTERNS[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 16 <= len(digits) <= 19 and luhn(digits)) or (kind == "phone" and 8 <= len(digits) <= 15):
                out.append((kind, *m.span()))
    return out


def test_entities_equal_the_patterns():
    pieces = ["a.b+c@d-e.f", "@", "x@y", "@b.c@d.e", "1.2.3.4", "256.1.1.1.1", "010.0.0.255", "1.2.3", ".", "4111 1111 1111 1111", "4111-1111-1111-1111-0", "5", " ", "-", "+1 (415) 555-0100", "+", "+12", "++1 234 567 890", "é", "\n", "٣٤", "word", "%", "()"]
    for _ in range(20000):
        text = "".join(R.choices(pieces, k=R.randrange(1, 9)))
        assert entities(text) == by_pattern(text), text
    for _ in range(5000):
        text = "".join(R.choices("a1@. -+(", k=R.randrange(1, 30)))
        assert entities(text) == by_pattern(text), text


@pytest.mark.parametrize("piece", ["a", "1", "a@", "1.", "1 ", "+1", "+1(", "@a.", "x@y-", "%+", " ", "1.1.1.256."])
def test_a_megabyte_takes_one_pass(piece):
    text = piece * (1_000_000 // len(piece))
    assert isinstance(entities(text), list)


def disclosing_by_force(docs):
    texts = [t or "" for _, t in docs]
    n, d_term, d_entity, d_kind, pairs = len(texts), {}, {}, {}, {}
    for t in texts:
        for w in {w.lower() for w in re.findall(r"\w+", t)}:
            d_term[w] = d_term.get(w, 0) + 1
        spans = by_pattern(t)
        inside = set().union(*[range(s, e) for _, s, e in spans])
        holes = "".join("\0" if i in inside else c for i, c in enumerate(t))
        terms = [(m[0].lower(), m.start()) for m in re.finditer(r"\w+", holes)]
        entities_here, here = set(), {}
        for kind, s, e in spans:
            value = value_of(kind, t[s:e])
            around = [w for w, at in terms if at < s][-WINDOW:] + [w for w, at in terms if at >= e][:WINDOW]
            entities_here.add((kind, value))
            for w in around:
                here.setdefault(((kind, value), w), []).append(frozenset(around))
        for group, counts in ((entities_here, d_entity), ({k for k, _ in entities_here}, d_kind)):
            for x in group:
                counts[x] = counts.get(x, 0) + 1
        for pair, contexts in here.items():
            pairs.setdefault(pair, []).append(contexts[0] if len(contexts) == 1 else min(contexts, key=sorted))
    out = {}
    for (e, w), contexts in pairs.items():
        told = n * len(contexts) / (d_entity[e] * d_term[w])
        pmi, ic = math.log2(told), math.log2(n / d_entity[e])
        if len(set(contexts)) >= SUPPORT and ic > 0 and told >= n / d_kind[e[0]] and pmi >= SHARE * ic:
            out[e, w] = "remove" if pmi >= ALL * ic else "generalise"
    return out


def spans_by_force(docs):
    told = disclosing_by_force(docs)
    out = []
    for i, t in docs:
        t = t or ""
        base = by_pattern(t)
        inside = set().union(*[range(s, e) for _, s, e in base])
        holes = "".join("\0" if k in inside else c for k, c in enumerate(t))
        terms = [m.span() for m in re.finditer(r"\w+", holes)]
        found = {}
        for kind, s, e in base:
            value = (kind, value_of(kind, t[s:e]))
            for a, b in [x for x in terms if x[0] < s][-WINDOW:] + [x for x in terms if x[0] >= e][:WINDOW]:
                action = told.get((value, t[a:b].lower()))
                if action:
                    found[a, b] = max(action, found.get((a, b), ""))
        out.append((i, base, [(a, b, action) for (a, b), action in sorted(found.items())]))
    return out


def filler(n):
    return " ".join(R.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho".split()) for _ in range(n))


def made_documents():
    rows = [(i, filler(40)) for i in range(120)]
    for i in range(200, 206):
        rows.append((i, f"{filler(15)} Zorblax Smith jane{i % 2}@corp.example.org {filler(20)}"))
    rows += [(300 + i, f"{filler(5)} call Quux +1 (415) 555-0100, {filler(12)} 10.0.0.{i} {filler(3)}") for i in range(5)]
    rows += [(310 + i, f"{filler(5)} quux {filler(12)}") for i in range(2)]
    rows += [(320 + i, f"{filler(5)} +1 (415) 555-020{i} {filler(12)}") for i in range(9)]
    rows += [(400, None), (401, ""), (None, rows[121][1]), (200, rows[0][1]), (402, "é jane0@corp.example.org 😀 zorblax ﬁ"), (403, f"pay 4111 1111 1111 1111 {filler(9)}")]
    return rows + [(500 + i, "same words once more near bob@corp.example.org rarity") for i in range(6)]


ROWS = made_documents()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "en", "x", "y", 1) for r in ROWS], DOCS).repartition(5)


def test_spans_match_brute_force(docs):
    got = personal_spans(docs).collect()
    want = spans_by_force(ROWS)
    assert sorted(((r.doc_id, [tuple(x) for x in r.base], [tuple(x) for x in r.terms]) for r in got), key=str) == sorted(want, key=str)
    actions = {(t[a:b].lower(), x) for (_, t), (_, _, terms) in zip(ROWS, want, strict=True) for a, b, x in terms}
    assert {w for w, _ in actions} >= {"zorblax", "quux"} and "rarity" not in {w for w, _ in actions} and not {w for w, _ in actions} & set(filler(500).split())
    assert {x for _, x in actions} == {"remove", "generalise"}


def test_digests(docs):
    got = {(r.doc_id, r.base_sha256, r.spans): r for r in span_digests(personal_spans(docs)).collect()}
    for i, base, terms in spans_by_force(ROWS):
        own = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        every = ",".join([own] * bool(own) + [f"term:{a}:{b}" for a, b, _ in terms])
        r = got[i, hashlib.sha256(own.encode()).hexdigest(), every]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in KINDS] and r.n_terms == len(terms)


def test_whole_table_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = spans_by_force([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = personal_spans(docs).collect()
    assert sorted((r.doc_id, [tuple(x) for x in r.base], [tuple(x) for x in r.terms]) for r in got) == sorted(want)


def test_sanitised_texts(docs):
    out = sanitised(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = {r.doc_id: r.text for r in out.collect()}
    own = dict(ROWS)
    assert texts[400] is None and texts[401] == "" and texts[3] == own[3]
    assert "[EMAIL]" in texts[201] and "jane" not in texts[201] and "orblax" not in texts[201]
    assert "[PHONE]" in texts[300] and "Quux" not in texts[300] and texts[310] == own[310]
    assert not any(by_pattern(t or "") for t in texts.values())


def test_sanitise_overlapping_spans():
    assert sanitise("+1 2345 6789 0 x", [("card", 1, 14), ("phone", 0, 14)], [(15, 16, "generalise")]) == "[PHONE] [TERM]"
    assert sanitise("Ann 12 b", [], [(0, 3, "generalise"), (4, 6, "generalise"), (7, 8, "remove")]) == "[NAME] [NUMBER] "


def test_empty_table_and_no_entities(spark):
    none = spark.createDataFrame([], DOCS)
    assert span_digests(personal_spans(none)).count() == 0 and sanitised(none).count() == 0
    plain = spark.createDataFrame([(1, "no data here", None, None, None, None)], DOCS)
    (r,) = span_digests(personal_spans(plain)).collect()
    assert (r.n_email, r.spans, r.base_sha256) == (0, "", hashlib.sha256(b"").hexdigest())


def test_a_very_long_text(spark):
    text = filler(200_000) + " jane@corp.example.org " + "9" * 500_000
    (r,) = personal_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [x.kind for x in r.base] == ["email"] and mentions(spark.createDataFrame([(1, text)], "doc_id long, text string")).count() == 1
