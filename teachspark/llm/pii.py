"""Operator 7: personal data by fixed rules, extended by bootstrapped contextual extraction.

Base spans (email, ip, card, phone) come from four patterns. They are the seeds: the words around
them are lexical patterns, and candidates (other tokens with digits or an at sign) that occur in
the same contexts are tied to those patterns. Patterns and instances form a graph that is scored in
rounds: a pattern's confidence in a kind is the share of its distinct instances that are of that
kind, an instance's is the noisy-or of its confident patterns. Candidates of the right shape whose
score passes the threshold become spans, and seeds of the next round.

Native: DataFrame and SQL functions only. Offsets of matches come from splitting a text by the same
pattern: a match begins where the gaps and matches before it end. Contexts are aggregated to
distinct (pattern, instance) pairs before anything is joined, and only confident patterns are
joined back, so a word that precedes a third of all candidates costs partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, forget

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns. Possessive quantifiers change no match (what follows a run can't be in it) and never back up;
#: an email or address begins a run of its characters, or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What may be an identifier that the patterns miss: numbers of 7 digits or more in groups, and tokens with a digit or at sign.
CANDIDATE = (
    r"(?<![A-Za-z0-9])\(?[0-9](?:[\x20().-]{0,2}+[0-9]){6,}+(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9._%+@-])(?=[A-Za-z._%+-]*+[0-9@])[A-Za-z0-9._%+@-]++"
)
#: What a candidate must look like to be accepted as a kind.
SHAPES = {
    "email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+$",
    "ip": r"^[0-9]{1,3}([.-][0-9]{1,3}){3}$",
    "card": r"^[0-9]([ -]?[0-9]){12,18}$",
    "phone": r"^\(?[0-9][ ().0-9-]*$",
}
#: Characters of context looked at on each side.
CONTEXT = 48
#: A pattern needs so many distinct instances of a kind, and so large a share of its instances, to speak for the kind.
SUPPORT, CONFIDENCE = 3, 0.8
#: The noisy-or score from which a candidate is accepted.
ACCEPT = 0.9

OCCURRENCE = "struct<kind:string,start:int,stop:int,value:string,before:string,after:string>"


def _literal(pattern: str) -> str:
    return "r'" + pattern + "'"


def _valid(kind: str) -> str:
    """SQL over an occurrence ``o``: whether the match counts (parts at most 255, Luhn, digits)."""
    digits = "regexp_replace(o.value, '[^0-9]', '')"
    luhn = (
        f"aggregate(sequence(0, length({digits}) - 1), 0, (s, i) -> s + "
        f"case when i % 2 = 0 then int(substr({digits}, length({digits}) - i, 1)) "
        f"else int(substr('0246813579', int(substr({digits}, length({digits}) - i, 1)) + 1, 1)) end) % 10 = 0"
    )
    return {
        "email": "true",
        "ip": r"forall(split(o.value, r'\.'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(ltrim('0', p) as int), 0) <= 255)",
        "card": f"length({digits}) between 13 and 19 and {luhn}",
        "phone": f"length({digits}) between 9 and 15",
    }[kind]


#: Elements that a running value is carried over at a time, and code points of a piece of text.
BLOCK, PIECE = 256, 4096


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` for a value that is computed once (a lambda would compute an outer expression at every element)."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _before(numbers: str, add: str) -> str:
    """SQL: for each of an array of integers what the ones before it add up to, from 0 on; ``add`` joins ``s`` and ``x``.

    Appending to an array copies it, so the sums run in blocks: over the blocks' totals, then inside each. An array of n
    costs n * BLOCK / 2 + (n / BLOCK)**2 / 2 copied integers instead of n**2 / 2.
    """
    none = "cast(array() as array<int>)"
    run = lambda items, first, step: f"aggregate({items}, named_struct('at', {first}, 'out', {none}), (a, y) -> named_struct('at', {step}, 'out', concat(a.out, array(a.at)))).out"
    total = "aggregate(y, a.at, (s, x) -> " + add + ")"
    inside = run("b", "o", _let("named_struct('s', a.at, 'x', y)", "p", add.replace("s", "p.s").replace("x", "p.x") if add == "s + x" else "greatest(p.s, p.x)"))
    blocks = f"if(size(z) = 0, cast(array() as array<array<int>>), transform(sequence(0, (size(z) - 1) div {BLOCK}), k -> slice(z, k * {BLOCK} + 1, {BLOCK})))"
    return _let(numbers, "z", _let(blocks, "blocks", f"flatten(zip_with(blocks, {run('blocks', '0', total)}, (b, o) -> {inside}))"))


def occurrences(text: str, pattern: str, kind: str, valid: str = "true") -> Column:
    """Matches of a pattern in a text column, leftmost and non-overlapping, as an array of ``OCCURRENCE`` (offsets in code points)."""
    found, gaps = f"regexp_extract_all({text}, {_literal(pattern)}, 0)", f"split({text}, {_literal(pattern)}, -1)"
    lengths = "zip_with(f.found, slice(f.gaps, 1, size(f.found)), (m, g) -> char_length(m) + char_length(g))"
    start = "at[i] + char_length(f.gaps[i])"
    one = (
        f"named_struct('kind', '{kind}', 'start', {start}, 'stop', {start} + char_length(f.found[i]), "
        f"'value', f.found[i], 'before', right(f.gaps[i], {CONTEXT}), 'after', left(f.gaps[i + 1], {CONTEXT}))"
    )
    rows = _let(_before(lengths, "s + x"), "at", f"transform(sequence(0, size(f.found) - 1), i -> {one})")
    inner = _let(f"named_struct('found', {found}, 'gaps', {gaps})", "f", rows)
    return F.expr(f"case when {text} rlike {_literal(pattern)} then filter({inner}, o -> {valid}) else cast(array() as array<{OCCURRENCE}>) end")


def base_spans(text: str = "text") -> Column:
    """All base spans of a text column, by kind as listed, then start (null and empty texts: none)."""
    return F.concat(*[F.coalesce(occurrences(text, PATTERNS[k], k, _valid(k)), F.expr(f"cast(array() as array<{OCCURRENCE}>)")) for k in KINDS])


def _contexts(o: str) -> str:
    """SQL: the lexical patterns around an occurrence. Words next to it tell whether white space parts them from it."""
    left = rf"lower(regexp_extract({o}.before, r'(\S+)(\s*)$', 1)) || if({o}.before rlike r'\s$', ' ', '')"
    two = rf"lower(regexp_extract({o}.before, r'(\S+\s+\S+\s*)$', 1))"
    right = rf"if({o}.after rlike r'^\s', ' ', '') || lower(regexp_extract({o}.after, r'^\s*(\S+)', 1))"
    return f"array('L ' || {left}, '2 ' || {two}, 'B ' || {left} || '_' || {right})"


def documents_spans(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, ``key`` (a hash of the text), base spans and candidates; written, so that texts are read once."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("key"), base_spans("text").alias("base"), occurrences("text", CANDIDATE, "").alias("candidates"))
    return cut(rows.select("doc_id", "key", "base", F.expr(_apart("base", "candidates")).alias("candidates")), "pii-spans")


def _apart(base: str, candidates: str) -> str:
    """SQL: the candidates that overlap no base span. Both are sorted as one by start: no base span before one may end
    behind its start, none after it may begin before its end (seen from the other end, with negated places)."""
    tagged = f"array_sort(concat(transform({candidates}, c -> named_struct('start', c.start, 'base', 0, 'stop', c.stop, 'o', c)), transform({base}, c -> named_struct('start', c.start, 'base', 1, 'stop', c.stop, 'o', c))))"
    ends = _before("transform(r, e -> if(e.base = 1, e.stop, 0))", "greatest(s, x)")
    # places behind the last end stand for no base span at all
    far = "(2147483647 - e.start)"
    begins = f"reverse({_before(f'reverse(transform(r, e -> if(e.base = 1, {far}, 0)))', 'greatest(s, x)')})"
    kept = "transform(filter(r, (e, i) -> e.base = 0 and low[i] <= e.start and 2147483647 - high[i] >= e.stop), e -> e.o)"
    return f"if(size({base}) = 0 or size({candidates}) = 0, {candidates}, {_let(tagged, 'r', _let(ends, 'low', _let(begins, 'high', kept)))})"


def discover(spans: DataFrame, rounds: int | None = None, support: int = SUPPORT, confidence: float = CONFIDENCE, accept: float = ACCEPT) -> DataFrame:
    """Candidate instances that confident patterns vouch for: ``(value, kind, score)``.

    ``spans`` is what :func:`documents_spans` gives. An instance is a candidate's text in lower
    case. Scores of equal instances are equal wherever they occur. Ties between kinds go to the
    kind listed first. Rounds go on until one accepts nothing new (or, if given, for so many rounds);
    what was accepted stays, with the score of its round. Without seeds or candidates the result is empty.
    """
    occ = spans.select(F.explode(F.concat("base", "candidates")).alias("o"))
    occ = occ.select(F.lower("o.value").alias("value"), F.nullif("o.kind", F.lit("")).alias("kind"), F.expr(f"explode({_contexts('o')})").alias("pattern"))
    # Contexts that are empty on the pattern's side say nothing.
    edges = cut(occ.where(F.trim(F.substring("pattern", 3, 2 * CONTEXT)) != "").groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "pii-edges")
    shape = F.coalesce(*[F.when(F.col("value").rlike(SHAPES[k]), F.lit(k)) for k in KINDS])
    accepted, done = None, 0
    while True:
        known = edges
        if accepted is not None:
            more = accepted.select("value", F.col("kind").alias("found"))
            known = edges.join(more, "value", "left").withColumn("kind", F.coalesce("kind", "found")).drop("found")
        sums = known.groupBy("pattern").agg(F.count("*").alias("n"), *[F.count_if(F.col("kind") == k).alias(k) for k in KINDS])
        told = F.array(*[F.struct((F.col(k) / F.col("n")).alias("share"), F.col(k).alias("support"), F.lit(k).alias("for")) for k in KINDS])
        sure = sums.select("pattern", F.explode(told).alias("x")).where((F.col("x.support") >= support) & (F.col("x.share") >= confidence)).select("pattern", "x.share", "x.for")
        vouched = known.where("kind is null").withColumn("shape", shape).where("shape is not null").join(sure, "pattern").where(F.col("for") == F.col("shape"))
        # A share of 1 counts as just under 1, so that the logarithm exists.
        score = 1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("share"), F.lit(1e-6)))))
        new = cut(vouched.groupBy("value", F.col("shape").alias("kind")).agg(score.alias("score")).where(F.col("score") >= accept), "pii-found")
        done += 1
        last = new.isEmpty() or done == rounds
        if accepted is None:
            accepted = new
        elif not new.isEmpty():
            accepted, old = cut(accepted.unionByName(new), "pii-accepted"), accepted
            forget(old)
            forget(new)
        if last:
            return accepted


def find_pii(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): base spans and the spans that the method adds.

    Returns ``doc_id, key, base, added``: arrays of ``OCCURRENCE``, ``key`` a hash of the text. Null
    texts count as empty; repeated rows stay repeated; an empty table gives an empty result.
    """
    spans = documents_spans(docs)
    found = discover(spans).withColumnRenamed("kind", "found")
    rows = spans.where(F.size("candidates") > 0).select("doc_id", "key", F.explode("candidates").alias("o")).withColumn("value", F.lower("o.value"))
    hits = rows.join(found, "value").select("doc_id", "key", F.col("o").withField("kind", F.col("found")).alias("o")).distinct()
    added = hits.groupBy("doc_id", "key").agg(F.collect_list("o").alias("added")).withColumnsRenamed({"doc_id": "__doc", "key": "__key"})
    joined = spans.join(added, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("key") == F.col("__key")), "left")
    return joined.select("doc_id", "key", "base", F.coalesce("added", F.expr(f"cast(array() as array<{OCCURRENCE}>)")).alias("added"))


def spans_string(spans: str) -> Column:
    """``kind:start:end``, by kind as listed, then start, joined by commas."""
    order = "array(" + ",".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(
        f"array_join(transform(array_sort(transform({spans}, o -> struct(array_position({order}, o.kind) as k, o.start, o.stop, o.kind))), "
        "o -> o.kind || ':' || o.start || ':' || o.stop), ',')"
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span, base or added, replaced by its kind in brackets; other columns and null texts stay as they are."""
    found = find_pii(docs).where(F.size("base") + F.size("added") > 0)
    keep = found.select(F.col("doc_id").alias("__doc"), F.col("key").alias("__key"), F.concat("base", "added").alias("__spans")).distinct()
    joined = docs.withColumn("__hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = joined.join(keep, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__hash") == F.col("__key")), "left")
    return joined.withColumn("text", F.expr(f"case when __spans is null then text else {_replaced('text', '__spans')} end")).select(*docs.columns)


def _replaced(text: str, spans: str) -> str:
    """SQL: the text with each span that begins behind all ends before it as its kind in brackets; the rest of overlapping ones goes too.

    A substring counts code points from its string's beginning, so gaps are put together from pieces of PIECE code points.
    """
    order = f"array_sort(transform({spans}, o -> named_struct('start', o.start, 'stop', o.stop, 'kind', o.kind)))"
    pieces = f"regexp_extract_all({text}, r'(?s).{{1,{PIECE}}}', 0)"

    def part(a: str, b: str) -> str:
        inside = f"substr(t[k], greatest({a} - k * {PIECE}, 0) + 1, least({b}, (k + 1) * {PIECE}) - greatest({a}, k * {PIECE}))"
        return f"if({b} <= {a}, '', array_join(transform(sequence({a} div {PIECE}, ({b} - 1) div {PIECE}), k -> {inside}), ''))"

    at = _before("transform(r, o -> o.stop)", "greatest(s, x)")
    shown = _let(at, "at", f"transform(filter(sequence(0, size(r) - 1), i -> r[i].start >= at[i]), i -> {part('at[i]', 'r[i].start')} || '[' || upper(r[i].kind) || ']')")
    # overlapping spans that aren't shown may end behind the ones that are
    tail = _let("named_struct('a', array_max(transform(r, o -> o.stop)), 'b', n)", "q", part("q.a", "q.b"))
    return _let(f"named_struct('r', {order}, 't', {pieces}, 'n', char_length({text}))", "v", _let("v.r", "r", _let("v.t", "t", _let("v.n", "n", f"array_join({shown}, '') || {tail}"))))
