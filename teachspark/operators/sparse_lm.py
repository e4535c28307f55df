"""T1 over large vocabularies: bigram models as observed pairs plus one back-off mass a context.

P(v | c) = (n(c, v) + a * u(v)) / (n(c) + a)

splits into a part that only observed pairs have and ``lam(c) * u(v)`` with
``lam(c) = a / (n(c) + a)``. Two models with one back-off distribution ``u`` are
then compared by a join of their observed pairs; the tokens that neither has
seen after a context add up in closed form, since there P = lt * u and
S = ls * u. Work and storage follow the pairs seen, never V squared.

Words are numbered before they are counted, so that what is shuffled follows the
pairs of ids. Only a vocabulary too large for a literal is a table, joined with
the distinct pairs of words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BOS_ID, EOS_ID, FIRST_WORD_ID, TOKEN_PATTERN, UNK_ID
from .table_lm import bigram_counts
from .tokenize import Vocabulary

#: Rows up to which a table whose size a parameter bounds (vocabulary, contexts) is broadcast.
BROADCAST_ROWS = 1_000_000
#: Words up to which a vocabulary becomes a literal lookup, so that words are numbered where they are split.
LITERAL_WORDS = 1 << 16
# Marks of a text's beginning and end; no word holds a space.
_BEGIN, _END = " b", " e"


def split_words(text: Column | str, pattern: str = TOKEN_PATTERN) -> Column:
    """The words of a text (none of a null text)."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), F.array().cast("array<string>"))


def vocabulary_table(texts: DataFrame, n_words: int, text_col: str = "text", pattern: str = TOKEN_PATTERN) -> DataFrame:
    """``(word, tok)``: the ``n_words`` most frequent words (then by word), numbered from FIRST_WORD_ID.

    Counting combines map-side; the numbering sorts the ``n_words`` rows that the top-k leaves.
    """
    counts = texts.select(F.explode(split_words(text_col, pattern)).alias("word")).groupBy("word").count()
    top = counts.orderBy(F.desc("count"), F.asc("word")).limit(n_words)
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("count"), F.asc("word")))
    return top.select("word", (rank + FIRST_WORD_ID - 1).cast("int").alias("tok"))


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table of at most ``rows`` rows if that is few enough; otherwise leave the join to Spark."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def number_words(df: DataFrame, vocab: DataFrame, n_words: int, columns: dict[str, str]) -> DataFrame:
    """Each word column ``k`` replaced by its id under the name ``v``; other words are UNK_ID."""
    for word, tok in columns.items():
        known = vocab.select(F.col("word").alias(word), F.col("tok").alias(tok))
        df = df.join(bounded(known, n_words), word, "left")
        special = F.when(F.col(word) == _BEGIN, BOS_ID).when(F.col(word) == _END, EOS_ID)
        df = df.withColumn(tok, F.coalesce(special, F.col(tok), F.lit(UNK_ID)).cast("int")).drop(word)
    return df


def literal_vocabulary(vocab: DataFrame, n_words: int, pattern: str = TOKEN_PATTERN) -> Vocabulary | None:
    """A vocabulary table as a literal lookup; None if it may have too many words or isn't numbered from FIRST_WORD_ID."""
    if n_words > LITERAL_WORDS:
        return None
    rows = vocab.select("word", "tok").orderBy("tok").limit(n_words + 1).collect()
    words = tuple(r["word"] for r in rows)
    numbered = [r["tok"] for r in rows] == list(range(FIRST_WORD_ID, FIRST_WORD_ID + len(rows)))
    return Vocabulary(words, pattern) if numbered and len(rows) <= n_words and None not in words and len(set(words)) == len(words) else None


def pair_counts(texts: DataFrame, vocab: DataFrame, n_words: int, text_col: str = "text", pattern: str = TOKEN_PATTERN) -> DataFrame:
    """``(ctx, tok, n)`` over all adjacent words, begin and end included; null texts count nothing."""
    known = literal_vocabulary(vocab, n_words, pattern)
    if known is not None:
        return bigram_counts(texts.select(known.ids(text_col).alias("input_ids")))
    s = F.concat(F.array(F.lit(_BEGIN)), split_words(text_col, pattern), F.array(F.lit(_END)))
    n = F.size("s") - 1
    pairs = F.arrays_zip(F.slice("s", 1, n).alias("w1"), F.slice("s", 2, n).alias("w2"))
    words = texts.where(F.col(text_col).isNotNull()).select(s.alias("s")).select(F.inline(pairs)).groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"))
    return number_words(words, vocab, n_words, {"w1": "ctx", "w2": "tok"}).groupBy("ctx", "tok").agg(F.sum("n").alias("n"))


def unigram(pairs: DataFrame, vocab_size: int, k: float = 1.0) -> DataFrame:
    """``(tok, u)`` for every id 1..V: successor counts with ``k`` added."""
    spark = pairs.sparkSession
    counts = pairs.where(F.col("tok").between(1, vocab_size)).groupBy("tok").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    every = spark.range(1, vocab_size + 1).select(F.col("id").cast("int").alias("tok"))
    share = (F.coalesce("n", F.lit(0)) + k) / (F.coalesce("total", F.lit(0)) + k * vocab_size)
    # ``total`` is one row
    return every.join(bounded(counts, vocab_size), "tok", "left").join(F.broadcast(total)).select("tok", share.alias("u"))


@dataclass
class SparseLM:
    """Observed pairs ``(ctx, tok, n)``, contexts ``(ctx, n_ctx)``, the back-off ``(tok, u)`` and its weight."""

    pairs: DataFrame
    contexts: DataFrame
    back_off: DataFrame
    alpha: float
    vocab_size: int

    def scored(self, df: DataFrame, out_col: str = "logp") -> DataFrame:
        """Adds log P(tok | ctx) to rows with ``ctx`` and ``tok``, seen together or not."""
        p = (F.coalesce("__n", F.lit(0)) + F.lit(self.alpha) * F.col("__u")) / (F.coalesce("__c", F.lit(0)) + F.lit(self.alpha))
        df = df.join(self.pairs.withColumnRenamed("n", "__n"), ["ctx", "tok"], "left")
        df = df.join(bounded(self.contexts.withColumnRenamed("n_ctx", "__c"), self.vocab_size), "ctx", "left")
        df = df.join(bounded(self.back_off.withColumnRenamed("u", "__u"), self.vocab_size), "tok")
        return df.withColumn(out_col, F.log(p)).drop("__n", "__c", "__u")

    def summary(self) -> DataFrame:
        """Per context: ``ctx, n_ctx, n_pairs, lam, entropy`` of the whole distribution, unseen tokens in closed form."""
        every = self.back_off.agg(F.sum(F.col("u") * F.log("u")).alias("__a"))
        rows = self.pairs.join(bounded(self.contexts, self.vocab_size), "ctx").join(bounded(self.back_off, self.vocab_size), "tok")
        p = (F.col("n") + self.alpha * F.col("u")) / (F.col("n_ctx") + F.lit(self.alpha))
        seen = rows.select("ctx", "n_ctx", "u", p.alias("p")).groupBy("ctx", "n_ctx").agg(
            F.count(F.lit(1)).alias("n_pairs"), F.sum(F.col("p") * F.log("p")).alias("h"), F.sum("u").alias("mass"), F.sum(F.col("u") * F.log("u")).alias("ulu")
        )
        lam = F.lit(self.alpha) / (F.col("n_ctx") + F.lit(self.alpha))
        rest = lam * (F.log(lam) * (1 - F.col("mass")) + F.col("__a") - F.col("ulu"))
        return seen.join(F.broadcast(every)).select("ctx", "n_ctx", "n_pairs", lam.alias("lam"), (-(F.col("h") + rest)).alias("entropy"))


def fit(pairs: DataFrame, back_off: DataFrame, vocab_size: int, alpha: float) -> SparseLM:
    pairs = pairs.where(F.col("ctx").between(1, vocab_size) & F.col("tok").between(1, vocab_size))
    return SparseLM(pairs, pairs.groupBy("ctx").agg(F.sum("n").alias("n_ctx")), back_off, alpha, vocab_size)


def context_divergence(teacher: SparseLM, student: SparseLM) -> DataFrame:
    """Per context either model has seen: ``ctx, kl_ts, kl_st, jsd_ref, gap2``.

    KL(P||S), KL(S||P), the reference's JSD, and ``gap2``, the squared length of S - P (the gradient of KL(P||S)
    by the student's logits at unit weight). Both models must share their back-off distribution. Contexts that
    neither has seen have P = S = u, so all four are 0 there: they have no row.
    """
    V = teacher.vocab_size
    if V != student.vocab_size:
        raise ValueError("the models' vocabularies differ")
    contexts = teacher.contexts.select("ctx", F.col("n_ctx").alias("ct")).join(student.contexts.select("ctx", F.col("n_ctx").alias("cs")), "ctx", "full")
    lam = lambda c, a: F.lit(a) / (F.coalesce(c, F.lit(0)) + F.lit(a))
    contexts = contexts.select("ctx", F.coalesce("ct", F.lit(0)).alias("ct"), F.coalesce("cs", F.lit(0)).alias("cs"), lam("ct", teacher.alpha).alias("lt"), lam("cs", student.alpha).alias("ls"))
    seen = teacher.pairs.select("ctx", "tok", F.col("n").alias("nt")).join(student.pairs.select("ctx", "tok", F.col("n").alias("ns")), ["ctx", "tok"], "full")
    rows = seen.join(bounded(contexts, V), "ctx").join(bounded(teacher.back_off, V), "tok")
    p = F.coalesce("nt", F.lit(0)) / (F.col("ct") + F.lit(teacher.alpha)) + F.col("lt") * F.col("u")
    s = F.coalesce("ns", F.lit(0)) / (F.col("cs") + F.lit(student.alpha)) + F.col("ls") * F.col("u")
    rows = rows.select("ctx", "lt", "ls", "u", p.alias("p"), s.alias("s")).select("*", F.log("p").alias("lp"), F.log("s").alias("lq"), F.log((F.col("p") + F.col("s")) / 2).alias("lm"))
    m = (F.col("p") + F.col("s")) / 2
    seen = rows.groupBy("ctx", "lt", "ls").agg(
        F.sum(F.col("p") * (F.col("lp") - F.col("lq"))).alias("a"),
        F.sum(F.col("s") * (F.col("lq") - F.col("lp"))).alias("b"),
        F.sum(F.lit(0.5) * m * (F.col("lm") - F.col("lp")) + F.lit(0.25) * m * (F.col("lm") - F.col("lq"))).alias("j"),
        F.sum((F.col("s") - F.col("p")) * (F.col("s") - F.col("p"))).alias("g"),
        F.sum("u").alias("mass"),
        F.sum(F.col("u") * F.col("u")).alias("mass2"),
    )
    squares = teacher.back_off.agg(F.sum(F.col("u") * F.col("u")).alias("__u2"))
    rest, lt, ls = F.greatest(F.lit(0.0), 1 - F.col("mass")), F.col("lt"), F.col("ls")
    mid = (lt + ls) / 2
    ratio = F.log(lt) - F.log(ls)
    return seen.join(F.broadcast(squares)).select(
        "ctx",
        (F.col("a") + lt * rest * ratio).alias("kl_ts"),
        (F.col("b") - ls * rest * ratio).alias("kl_st"),
        (F.col("j") + mid * rest * (F.lit(0.5) * (F.log(mid) - F.log(lt)) + F.lit(0.25) * (F.log(mid) - F.log(ls)))).alias("jsd_ref"),
        (F.col("g") + (ls - lt) * (ls - lt) * F.greatest(F.lit(0.0), F.col("__u2") - F.col("mass2"))).alias("gap2"),
    )


def batch_means(positions: DataFrame, divergence: DataFrame, vocab_size: int, by: list[str]) -> DataFrame:
    """A6 from positions' contexts: counted by (batch, context) first; contexts that neither model has seen add 0."""
    cols = ("kl_ts", "kl_st", "jsd_ref")
    counts = positions.groupBy(*by, "ctx").agg(F.count(F.lit(1)).alias("__n"))
    rows = counts.join(bounded(divergence.select("ctx", *cols), vocab_size), "ctx", "left").fillna(0.0, list(cols))
    total = F.sum("__n")
    return rows.groupBy(*by).agg(total.alias("n_positions"), *[(F.sum(F.col("__n") * F.col(c)) / total).alias(c) for c in cols])


def step_weights(positions: DataFrame, world_size: int, by: tuple[str, ...] = ("step",)) -> DataFrame:
    """``(*by, ctx, w)``: ``w = sum_r n(step, r, ctx) / (R * N(step, r))`` for every step at once.

    One count by (step, rank, ctx); only contexts that a step touches have rows.
    """
    counts = positions.groupBy(*by, "rank", "ctx").agg(F.count(F.lit(1)).alias("__cnt"))
    per_rank = counts.groupBy(*by, "rank").agg(F.sum("__cnt").alias("__rank_n"))
    both = counts.join(per_rank, [*by, "rank"])
    return both.groupBy(*by, "ctx").agg(F.sum(F.col("__cnt") / (F.lit(float(world_size)) * F.col("__rank_n"))).alias("w"))


def step_gradients(weights: DataFrame, teacher: SparseLM, student: SparseLM, by: tuple[str, ...] = ("step",)) -> DataFrame:
    """T2 for every step at once (loss KL(P||S), student at its fitted parameters): ``(*by, ctx, tok, g)``.

    Rows of observed pairs in touched contexts, and for each step and touched context one row with a null ``tok``:
    the gradient of every other token v of that context is ``g * u(v)``.
    """
    V = teacher.vocab_size
    lam = lambda model, name: bounded(model.contexts.select("ctx", (F.lit(model.alpha) / (F.col("n_ctx") + F.lit(model.alpha))).alias(name)), V)
    touched = weights.join(lam(teacher, "lt"), "ctx", "left").join(lam(student, "ls"), "ctx", "left").fillna(1.0, ["lt", "ls"])
    share = lambda model, name: model.pairs.join(bounded(model.contexts, V), "ctx").select("ctx", "tok", (F.col("n") / (F.col("n_ctx") + F.lit(model.alpha))).alias(name))
    seen = share(teacher, "pt").join(share(student, "ps"), ["ctx", "tok"], "full").fillna(0.0, ["pt", "ps"]).join(bounded(teacher.back_off, V), "tok")
    rows = touched.join(seen, "ctx")
    g = F.col("w") * (F.col("ps") - F.col("pt") + (F.col("ls") - F.col("lt")) * F.col("u"))
    rest = touched.select(*by, "ctx", F.lit(None).cast("int").alias("tok"), (F.col("w") * (F.col("ls") - F.col("lt"))).alias("g"))
    return rows.select(*by, "ctx", "tok", g.alias("g")).unionByName(rest)


def step_norms(weights: DataFrame, divergence: DataFrame, vocab_size: int, by: tuple[str, ...] = ("step",)) -> DataFrame:
    """``(*by, loss, grad_norm)`` of every step from the contexts' divergences: no gradient row is made."""
    rows = weights.join(bounded(divergence.select("ctx", "kl_ts", "gap2"), vocab_size), "ctx", "left").fillna(0.0, ["kl_ts", "gap2"])
    return rows.groupBy(*by).agg(F.sum(F.col("w") * F.col("kl_ts")).alias("loss"), F.sqrt(F.sum(F.col("w") * F.col("w") * F.col("gap2"))).alias("grad_norm"))
