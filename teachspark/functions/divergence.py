"""A1-A5 over dense logit arrays (one array per position), in double precision.

Only for small vocabularies (fixtures, table models): a dense array per
position does not scale with a large vocabulary (see README, scale rules).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def _minus(arr: Column, scalar: Column) -> Column:
    """``arr - scalar`` elementwise.

    The scalar enters through ``array_repeat`` so that the lambda only reads
    lambda variables: a lambda that names an outer expression gets it inlined
    and re-evaluated for every element (quadratic per row).
    """
    return F.zip_with(arr, F.array_repeat(scalar, F.size(arr)), lambda x, s: x - s)


def log_softmax(logits: Column | str) -> Column:
    """A1: max-shifted log-softmax, computed in double."""
    z = F.transform(_c(logits), lambda x: x.cast("double"))
    shifted = _minus(z, F.array_max(z))
    lse = F.log(F.aggregate(shifted, F.lit(0.0).cast("double"), lambda acc, x: acc + F.exp(x)))
    return _minus(shifted, lse)


def kl(log_a: Column | str, log_b: Column | str) -> Column:
    """KL(A||B) = sum exp(a) (a - b) for log-probability arrays a, b."""
    return _sum(F.zip_with(_c(log_a), _c(log_b), lambda a, b: F.exp(a) * (a - b)))


def kl_teacher_student(log_p: Column | str, log_q: Column | str) -> Column:
    """A2 (the reference's ``rkl``): KL(P||S), teacher P, student S."""
    return kl(log_p, log_q)


def kl_student_teacher(log_p: Column | str, log_q: Column | str) -> Column:
    """A3 (the reference's ``fkl``): KL(S||P)."""
    return kl(log_q, log_p)


def _log_mix(log_p: Column, log_q: Column, beta: float) -> Column:
    return F.zip_with(
        log_p, log_q, lambda a, b: F.log(F.lit(beta) * F.exp(a) + F.lit(1.0 - beta) * F.exp(b))
    )


def jsd_reference(log_p: Column | str, log_q: Column | str) -> Column:
    """A4: the reference's ``jsd``: 0.5 KL(M||P) + 0.25 KL(M||S), M = (P+S)/2."""
    lp, lq = _c(log_p), _c(log_q)
    lm = _log_mix(lp, lq, 0.5)
    return F.lit(0.5) * kl(lm, lp) + F.lit(0.25) * kl(lm, lq)


def jsd_beta(log_p: Column | str, log_q: Column | str, beta: float = 0.5) -> Column:
    """A5: generalised JSD(beta) = beta KL(P||M) + (1-beta) KL(S||M), M = beta P + (1-beta) S."""
    lp, lq = _c(log_p), _c(log_q)
    lm = _log_mix(lp, lq, beta)
    return F.lit(beta) * kl(lp, lm) + F.lit(1.0 - beta) * kl(lq, lm)


# Compatibility names as the reference's loss options spell them.
REFERENCE_LOSSES = {
    "rkl": kl_teacher_student,
    "fkl": kl_student_teacher,
    "jsd": jsd_reference,
}
