"""Operator 7 against Python's matcher, and what contexts add."""

import re

from teachspark.llm.pii import discover, documents_spans, find_pii, redact, spans_string

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else int("0246813579"[int(c)]) for i, c in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, r in RULES.items() for m in re.finditer(r, text or "") if valid(k, m.group()))


CASES = ["a@b.c_d@e.f x.y@z", "1.2.3.4.5.6.7.8 01.002.255.256 1.2.3.4", "a@b.c.d@e.f", "++1 (234) 555-1234--9 +12345678", "4111 1111 1111 1111 4111111111111112", "\U0001f600 a@b.co é +4 5 6 7 8 9 0 1 2 3", "%+-@a.b @c.d e@.f", "1" * 500, "a@" + "b." * 3000 + "c", "0000000001.2.3.4 99999999999.1.1.1"]


def test_base_spans(spark, edge_docs, no_docs):
    df = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    got = {r.doc_id: r.s for r in find_pii(df).select("doc_id", spans_string("base").alias("s")).collect()}
    assert got == {i: brute(t) for i, t in enumerate(CASES)}
    got = sorted((r.doc_id or 0, r.s) for r in find_pii(edge_docs).select("doc_id", spans_string("base").alias("s")).collect())
    assert got == sorted((r.doc_id or 0, brute(r.text)) for r in edge_docs.collect())
    assert find_pii(no_docs).count() == 0


def test_contexts_discover_unseen_identifiers(spark):
    rows = [f"please phone me on +1 (212) 555-{i:04d} today" for i in range(20)]
    rows += ["please phone me on (212) 555-7777 today", "please phone me on 21255588 99 today"]
    rows += [f"there were {1000000 + i} people in 12.000.0{i} lines" for i in range(20)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {(r.value, r.kind) for r in discover(documents_spans(df)).collect()}
    assert ("(212) 555-7777", "phone") in found and not any(v.startswith("10000") for v, _ in found)
    out = {r.doc_id: r.text for r in redact(df).collect()}
    assert out[3] == "please phone me on [PHONE] today" == out[20] and out[30] == rows[30]


def test_redact_keeps_everything_else(spark, edge_docs):
    before, after = edge_docs.collect(), redact(edge_docs).collect()
    assert redact(edge_docs).columns == edge_docs.columns
    assert sorted(map(str, before)) == sorted(map(str, after))


def test_texts_of_thousands_of_matches(spark):
    """More matches than a block, of every kind, failing ones between them."""
    import random

    random.seed(7)
    some = ["10.0.%d.7", "10.300.%d.7", "a%d@b.co", "+1 (234) 555-%04d", "4111 1111 1111 1111", "4111 1111 1111 %04d", "word%d", "é%d \U0001f600"]
    texts = ["; ".join(s % i if "%" in s else s for i in range(n) for s in [random.choice(some)]) for n in (255, 256, 257, 3000)]
    texts.append(" ".join(f"10.{i % 256}.{i // 256 % 256}.7" for i in range(20_000)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = documents_spans(df).select("doc_id", "base", "candidates", spans_string("base").alias("s")).collect()
    assert {r.doc_id: r.s for r in spans} == {i: brute(t) for i, t in enumerate(texts)}
    for r in spans:
        taken = set(p for o in r.base for p in range(o.start, o.stop))
        assert all(texts[r.doc_id][c.start : c.stop] == c.value and not taken.intersection(range(c.start, c.stop)) for c in r.candidates)
    out = {r.doc_id: r.text for r in redact(df).collect()}
    assert out[4] == " ".join(["[IP]"] * 20_000)
    for i, text in enumerate(texts):
        found = sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in brute(text).split(",")))
        at, parts = 0, []
        for a, b, k in found:
            if a >= at:
                parts.append(text[at:a] + f"[{k.upper()}]")
            at = max(at, b)
        assert out[i] == "".join(parts) + text[at:], i


def test_candidates_apart_from_base_spans(spark):
    from teachspark.llm.pii import OCCURRENCE, _apart

    import random

    random.seed(8)
    one = lambda a, n: ("", a, a + n, "", "", "")
    rows = [(i, [one(random.randrange(300), random.randrange(1, 9)) for _ in range(random.randrange(20))], [one(random.randrange(300), random.randrange(1, 12)) for _ in range(random.randrange(30))]) for i in range(60)]
    df = spark.createDataFrame(rows, f"i int, base array<{OCCURRENCE}>, candidates array<{OCCURRENCE}>")
    for r in df.selectExpr("i", f"{_apart('base', 'candidates')} as kept").collect():
        _, base, candidates = rows[r.i]
        want = [c for c in candidates if not any(c[1] < b[2] and b[1] < c[2] for b in base)]
        assert sorted((o.start, o.stop) for o in r.kept) == sorted((c[1], c[2]) for c in want)


def test_rounds_go_on_while_they_find_something(spark):
    """Seeds stand behind 'alpha'; what 'alpha' vouches for also stands behind 'beta', and so on: one context a round."""
    group = lambda k, n: [f"({k}12) 555-{i:04d}" for i in range(n)]
    behind = {"alpha": [f"+1 (212) 555-{i:04d}" for i in range(100)] + group(3, 20), "beta": group(3, 20) + group(4, 5), "gamma": group(4, 5) + group(9, 1)}
    rows = [f"call {name} {x} end{name}{i}" for name, numbers in behind.items() for i, x in enumerate(numbers)]
    spans = documents_spans(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    found = [{r.value for r in discover(spans, rounds=n).collect()} for n in (1, 2, None)]
    assert found[0] == set(group(3, 20)) and found[1] - found[0] == set(group(4, 5)) and found[2] - found[1] == {"(912) 555-0000"}
