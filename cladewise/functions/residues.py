"""Column functions over the residues of one alignment site.

A site is an array of one-letter residues by slot; slots 2k and 2k+1 are pair k, even ones
convergent and odd ones control. Everything is a built-in expression.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

GAP, UNKNOWN = "-", "?"
#: Slots that one word of a mask has bits for.
WORD = 62
#: What the site counter takes for missing.
MISSING = ("?", "-", "X", "x")


def ungapped(res: Column) -> Column:
    return F.filter(res, lambda x: x != GAP)


def clean(res: Column) -> Column:
    return F.filter(res, lambda x: ~x.isin(*MISSING))


def count_in(res: Column, value: Column) -> Column:
    return F.size(F.filter(res, lambda x: x == value))


def counts(res: Column) -> Column:
    """How often each distinct residue of ``res`` occurs."""
    return F.transform(F.array_distinct(res), lambda d: count_in(res, d))


def is_variable(res: Column) -> Column:
    """At least two residues, neither all single nor all but one alike; gaps don't count."""
    r = F.translate(F.array_join(res, ""), GAP, "")
    # All alike but one at most: the odd one stands after the first, or is the first.
    return ~r.rlike(r"^((.)\2*(.\2*)?|.(.)\4*)?$") & r.rlike(r"(.).*\1")


def informative_residues(res: Column, min_count: int = 2) -> Column:
    """Residues that become features, in byte order; none unless two others differ from the commonest."""
    r = ungapped(res)
    good = is_variable(res) & (F.size(r) - F.array_max(counts(r)) >= 2)
    found = F.array_sort(F.filter(F.array_distinct(r), lambda d: count_in(r, d) >= min_count))
    return F.when(good, found).otherwise(F.array().cast("array<string>"))


def slot_mask(res: Column, value: Column, wide: bool = False) -> Column:
    """Bit ``slot`` is set where ``res`` has ``value``: a long, or if ``wide`` an array of longs of ``WORD`` slots
    each. More slots than a long holds are an error."""
    word = lambda part: F.aggregate(
        F.transform(part, lambda x, i: F.when(x == value, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"), lambda a, x: a + x,
    )
    if wide:
        words = F.sequence(F.lit(0), F.floor((F.greatest(F.size(res), F.lit(1)) - 1) / WORD).cast("int"))
        return F.transform(words, lambda w: word(F.slice(res, w * WORD + 1, F.lit(WORD))))
    return F.when(F.size(res) > WORD, F.raise_error(F.lit(f"more than {WORD} slots: ask for wide masks"))).otherwise(word(res))


def slots_of(mask: Column, wide: bool = False) -> Column:
    """The slots whose bits are set, in order."""
    on = lambda word, first: F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.call_function("shiftright", word, i).bitwiseAND(F.lit(1).cast("long")) != 0), lambda i: i + first
    )
    return F.flatten(F.transform(mask, lambda w, k: on(w, k * WORD))) if wide else on(mask, F.lit(0))


def mask_bits(masks: list | np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """0/1 rows of the distinct masks, ``n`` slots each, and each mask's row."""
    words = np.array(masks, np.int64).reshape(len(masks), -1)
    if words.shape[1] == 1:
        kinds, of = np.unique(words[:, 0], return_inverse=True)
        kinds = kinds[:, None]
    else:
        kinds, of = np.unique(words, axis=0, return_inverse=True)
    bits = (kinds[:, :, None] >> np.arange(WORD)) & 1
    return bits.reshape(len(kinds), -1)[:, :n].astype(float), of.reshape(-1)


def side(res: Column, parity: int) -> Column:
    """The convergent (0) or control (1) residues."""
    return F.filter(res, lambda x, i: i % 2 == parity)


def masked(own: Column, both: Column) -> Column:
    """``own`` with residues that occur once in ``both`` as unknown; gaps stay."""
    return F.transform(own, lambda x: F.when((x != GAP) & (count_in(both, x) == 1), F.lit(UNKNOWN)).otherwise(x))


def cs_score(conv: Column, ctrl: Column) -> Column:
    """Differences of residue counts between the masked sides, less gaps, at least 0."""
    a, b = clean(conv), clean(ctrl)
    kinds = F.array_distinct(F.concat(a, b))
    raw = F.aggregate(F.transform(kinds, lambda d: F.abs(count_in(a, d) - count_in(b, d))), F.lit(0), lambda s, x: s + x)
    gaps = F.size(F.filter(F.concat(conv, ctrl), lambda x: x == GAP))
    return F.greatest(raw - gaps, F.lit(0))


def ancestral_set(out: Column, states: Column | None = None, unambiguous: bool = False) -> Column:
    """Reconstructed states if given, else the outgroup's residue if it is known."""
    single = F.when(~out.isin(*MISSING), F.array(out)).otherwise(F.array().cast("array<string>"))
    found = single if states is None else F.coalesce(states, single)
    return F.when(F.size(found) > 1, F.array().cast("array<string>")).otherwise(found) if unambiguous else found


def _twice_outside(res: Column, ancestral: Column) -> Column:
    return F.exists(F.array_distinct(res), lambda d: ~F.array_contains(ancestral, d) & (count_in(res, d) >= 2))


def is_ccs(conv: Column, ctrl: Column, ancestral: Column, min_agreement: float = 1.0) -> Column:
    """Enough controls have an ancestral state, and two convergent ones share another."""
    a, b = clean(conv), clean(ctrl)
    least = max(0.0, min(1.0, min_agreement))
    agree = F.size(F.filter(b, lambda x: F.array_contains(ancestral, x))) >= F.lit(least) * F.size(b) - 1e-12
    return (F.size(ancestral) > 0) & (F.size(b) > 0) & agree & _twice_outside(a, ancestral)


def is_control_convergence(conv: Column, ctrl: Column, ancestral: Column) -> Column:
    """All convergent ones have an ancestral state, and two controls share another."""
    a, b = clean(conv), clean(ctrl)
    return (F.size(ancestral) > 0) & (F.size(a) > 0) & F.forall(a, lambda x: F.array_contains(ancestral, x)) & _twice_outside(b, ancestral)


def cancelled(res: Column, intact: Column, out: Column | None, min_pairs: int, only_partner: bool, tri_allelic: bool) -> Column:
    """Gap cancellation of a site; ``intact`` is the gene's number of pairs with both species."""
    n = F.size(res)
    blank = F.transform(res, lambda x: F.lit(GAP))
    gap = F.array_contains(res, GAP)
    pair_gap = lambda i: (F.get(res, i - i % 2) == GAP) | F.coalesce(F.get(res, i - i % 2 + 1) == GAP, F.lit(False))
    if only_partner:
        paired = F.transform(res, lambda x, i: F.when(pair_gap(i), F.lit(GAP)).otherwise(x))
        left = F.size(F.filter(F.transform(res, lambda x, i: (i % 2 == 0) & ~pair_gap(i)), lambda x: x))
        step = F.when(~gap, res).when(left < min_pairs, blank).otherwise(paired)
        dead = gap & (left < min_pairs)
    else:
        step, dead = F.when(gap, blank).otherwise(res), gap
    if out is not None:
        known = out.isNotNull() & (out != GAP)
        dead = dead | (known & F.exists(side(step, 1), lambda x: x != out))
    if tri_allelic:
        dead = dead | ((n == 4) & (F.size(F.array_distinct(step)) == 3))
    whole = (n % 2 == 0) & (intact < min_pairs)
    return F.when(whole | F.coalesce(dead, F.lit(False)), blank).otherwise(step)
