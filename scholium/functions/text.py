"""Column helpers for text: Unicode-safe patterns, line splitting, rounding, first-by-key.

Patterns are written with ``\\w \\s \\d`` and expanded by :func:`uni` to explicit Unicode
classes, so that they mean the same in Java and in RE2 whatever flags an engine defaults to.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WS_SET = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WORD_SET = r"\p{L}\p{N}_"
DIGIT_SET = r"\p{Nd}"
WS_CHARS = "".join(
    chr(c)
    for c in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
_CLASSES = {"w": WORD_SET, "s": WS_SET, "d": DIGIT_SET}


def uni(pattern: str) -> str:
    """Expand ``\\w \\s \\d \\S`` to explicit Unicode classes, inside and outside brackets."""
    out, in_class = [], False
    for tok in re.findall(r"\\.|.", pattern, flags=re.S):
        if tok[0] == "\\" and tok[1] in _CLASSES:
            body = _CLASSES[tok[1]]
            out.append(body if in_class else f"[{body}]")
            continue
        if tok == r"\S" and not in_class:
            out.append(f"[^{WS_SET}]")
            continue
        if tok == "[" and not in_class:
            in_class = True
        elif tok == "]" and in_class:
            in_class = False
        out.append(tok)
    return "".join(out)


def first_n(items: Column, n: int | None) -> Column:
    """The first ``n`` items; all of them without a limit."""
    return items if n is None else F.slice(items, 1, n)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once: expressions inside lambdas get no common-subexpression reuse."""
    return F.transform(F.array(value), body)[0]


def sub(col: Column, pattern: str, replacement: str = "") -> Column:
    return F.regexp_replace(col, F.lit(pattern), F.lit(replacement))


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WS_CHARS))


def rstrip(col: Column) -> Column:
    return F.rtrim(col, F.lit(WS_CHARS))


def is_upper(col: Column) -> Column:
    # a small letter near the beginning settles most lines before any is mapped
    return ~has(F.substr(col, F.lit(1), F.lit(40)), "[a-z]") & (F.upper(col) == col) & (F.lower(col) != col)


def has(col: Column, pattern: str) -> Column:
    return F.regexp_like(col, F.lit(pattern))


def extract(col: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(col, pattern, group)


def extract_all(col: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(group))


def empty_strings() -> Column:
    return F.array().cast("array<string>")


LINE_BREAKS = r"\r\n|[\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def split_lines(col: Column) -> Column:
    """Lines of a text; no line for an empty text, no extra line after a final break."""
    unified = sub(sub(col, LINE_BREAKS, "\n"), r"\n\z")
    return F.when(F.coalesce(col, F.lit("")) == "", empty_strings()).otherwise(
        F.split(unified, "\n", -1)
    )


def first_by_key(
    items: Column,
    key: Callable[[Column], Column],
    always_keep: Callable[[Column], Column] | None = None,
) -> Column:
    """Elements whose key did not occur earlier in the array, in order: O(n log n) in the row.

    ``always_keep`` marks keys that are exempt from de-duplication.
    """

    def dedup(keyed: Column) -> Column:
        def scan(ranked: Column) -> Column:
            def fresh(x: Column, i: Column) -> Column:
                new = (i == 0) | (ranked[F.greatest(i - 1, F.lit(0))]["k"] != x["k"])
                return new | always_keep(x["k"]) if always_keep else new

            return F.filter(ranked, fresh)

        kept = let(F.sort_array(keyed), scan)
        by_position = F.sort_array(
            F.transform(kept, lambda x: F.struct(x["i"].alias("i"), x["v"].alias("v")))
        )
        return F.transform(by_position, lambda x: x["v"])

    keyed = F.transform(
        items, lambda v, i: F.struct(key(v).alias("k"), i.alias("i"), v.alias("v"))
    )

    def choose(keyed: Column) -> Column:
        keys = F.transform(keyed, lambda x: x["k"])
        if always_keep:
            keys = F.filter(keys, lambda k: ~always_keep(k))
        no_repeats = let(keys, lambda ks: F.size(F.array_distinct(ks)) == F.size(ks))
        return F.when(no_repeats, F.transform(keyed, lambda x: x["v"])).otherwise(dedup(keyed))

    return let(keyed, choose)


def repeats_by_key(items: Column, key: Callable[[Column], Column]) -> Column:
    """Elements whose key occurred earlier in the array, in order: the rest of first_by_key."""

    def repeated(keyed: Column) -> Column:
        later = let(
            F.sort_array(keyed),
            lambda ranked: F.filter(
                ranked,
                lambda x, i: (i > 0) & (ranked[F.greatest(i - 1, F.lit(0))]["k"] == x["k"]),
            ),
        )
        return F.transform(
            F.sort_array(F.transform(later, lambda x: F.struct(x["i"].alias("i"), x["v"].alias("v")))),
            lambda x: x["v"],
        )

    keyed = F.transform(
        items, lambda v, i: F.struct(key(v).alias("k"), i.alias("i"), v.alias("v"))
    )
    return let(keyed, repeated)


def _two_sum_error(a: Column, b: Column, s: Column) -> Column:
    """Rounding error of s = a + b, exactly (branch-free two-sum)."""
    bb = s - a
    return (a - (s - bb)) + (b - bb)


def round_exact(col: Column, digits: int) -> Column:
    """Round the exact binary value, ties to even, to 1 or 2 decimals.

    Spark's ``round``/``bround`` round the shortest decimal form of a double, so 0.35 (which is
    below 0.35 in binary) would go up. Doubling the scaled value puts ties on odd integers; the
    error of the scaling is recovered with two-sum, so the side of the tie is known exactly.
    """
    if digits == 1:
        parts, scale = (16.0, 4.0), 10.0
    elif digits == 2:
        parts, scale = (128.0, 64.0, 8.0), 100.0
    else:
        raise ValueError("digits must be 1 or 2")

    def with_sum(x: Column) -> Column:
        def add(acc: Column, factor: float) -> Column:
            return let(
                acc,
                lambda a: let(
                    a["s"] + x * factor,
                    lambda s: F.struct(
                        s.alias("s"),
                        (a["e"] + _two_sum_error(a["s"], x * factor, s)).alias("e"),
                    ),
                ),
            )

        acc = F.struct((x * parts[0]).alias("s"), F.lit(0.0).alias("e"))
        for factor in parts[1:]:
            acc = add(acc, factor)

        def decide(a: Column) -> Column:
            low = F.floor(a["s"] / 2.0)
            side = (a["s"] - (low * 2.0 + 1.0)) + a["e"]
            up = (side > 0) | ((side == 0) & (F.pmod(low, F.lit(2)) == 1))
            return (low + F.when(up, 1).otherwise(0)).cast("double") / scale

        return let(acc, decide)

    return F.when(col.isNotNull(), let(col.cast("double"), with_sum))
