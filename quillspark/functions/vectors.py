"""Vectors as Columns: cosine in double precision and the hashing embedder."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import tokens


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once, however often f names it: as the one element of an array it is a lambda's variable.
    Inside lambdas Spark finds no common expressions by itself."""
    return F.element_at(F.transform(F.array(value), f), 1)


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """M1: 0 where a norm is 0."""

    def of(x: Column, y: Column) -> Column:
        return once(F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)), lambda n: F.when(n > 0, dot(x, y) / n).otherwise(0.0))

    return once(a, lambda x: once(b, lambda y: of(x, y)))


def token_bin(token: Column, dims: int) -> Column:
    """The first four bytes of the md5, low byte first, modulo dims."""
    m = F.md5(token)
    if 256 % dims == 0:  # the other bytes are multiples of dims
        return F.conv(F.left(m, F.lit(2)), 16, 10).cast("int") % dims
    word = F.concat(*[F.substring(m, i, 2) for i in (7, 5, 3, 1)])
    return F.conv(word, 16, 10).cast("long") % dims


def hash_embed(text: Column, dims: int = 64) -> Column:
    """The default embedder: counts of tokens in hashed bins. Two texts' cosine is that of their counts."""
    bins = F.transform(tokens(text), lambda t: token_bin(t, dims))
    # The bins are dealt into about sqrt(dims) runs first, so each is looked at that often and not for every dimension.
    # As the one element of an array they are a lambda's variable: they are made once.
    width = math.isqrt(dims - 1) + 1

    def run(bs: Column, start: Column) -> Column:
        own = F.filter(bs, lambda b: (b >= start) & (b < start + width))
        ends = F.sequence(start, F.least(start + width, F.lit(dims)) - 1)
        return F.flatten(F.transform(F.array(own), lambda o: F.transform(ends, lambda i: F.size(F.filter(o, lambda b: b == i)).cast("float"))))

    starts = F.array(*[F.lit(i) for i in range(0, dims, width)])
    return F.flatten(F.flatten(F.transform(F.array(bins), lambda bs: F.transform(starts, lambda s: run(bs, s)))))
