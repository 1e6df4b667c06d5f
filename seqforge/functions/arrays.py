"""Array / sequence feature operators as Column -> Column functions.

All are higher-order SQL expressions (``slice``, ``transform``, ``sequence``,
``array_repeat``) evaluated inside whole-stage code generation; no Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Fixed special ids of the recurrent model's vocabulary.
PAD_ID, SOS_ID, EOS_ID, UNK_ID = 0, 1, 2, 3


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def once(value: Column, f) -> Column:
    """``f(value)`` with ``value`` worked out once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def repeat(value, n: Column) -> Column:
    """``array_repeat`` that accepts a non-positive count (empty array)."""
    return F.array_repeat(_lit(value), F.greatest(n, F.lit(0)).cast("int"))


def safe_slice(arr: ColumnOrName, start, length) -> Column:
    """1-based slice with a length clamped at 0 (Spark rejects negative lengths)."""
    return F.slice(_c(arr), _lit(start), F.greatest(_lit(length), F.lit(0)))


def take(arr: ColumnOrName, n) -> Column:
    """``arr[:n]``."""
    return safe_slice(arr, 1, F.least(_lit(n), F.size(_c(arr))))


def zero_cut(arr: ColumnOrName, stop=0) -> Column:
    """Cut a list at the first ``stop`` value (default 0), which is dropped."""
    a = _c(arr)
    p = F.array_position(a, _lit(stop))
    return F.when(p > 0, safe_slice(a, 1, p - 1)).otherwise(a)


def pad_array(arr: ColumnOrName, max_len: int, pad=PAD_ID) -> Column:
    """Right-pad to ``max_len``; a longer array is an error (frames cut theirs before)."""
    def padded(a: Column) -> Column:
        long = F.raise_error(F.concat(F.lit(f"array longer than {max_len}: "), F.size(a).cast("string")))
        return F.when(F.size(a) > max_len, long).otherwise(F.concat(a, repeat(pad, F.lit(max_len) - F.size(a))))
    return once(_c(arr), padded)


def frame_sos_eos_pad(arr: ColumnOrName, max_len: int) -> Column:
    """zero-cut, keep ``max_len-2``, ``[SOS]+x+[EOS]``, pad with PAD to ``max_len``."""
    body = take(zero_cut(arr), max_len - 2)
    framed = F.concat(F.array(F.lit(SOS_ID).cast("bigint")), body.cast("array<bigint>"),
                      F.array(F.lit(EOS_ID).cast("bigint")))
    return pad_array(framed, max_len, F.lit(PAD_ID).cast("bigint"))


def framed_length(arr: ColumnOrName, max_len: int) -> Column:
    """Length returned with a framed row: excludes SOS/EOS."""
    return F.size(take(zero_cut(arr), max_len - 2))


def pad_context(arr: ColumnOrName, max_len: int) -> Column:
    """Context row: zero-cut, keep ``max_len-2``, no framing, pad to ``max_len``."""
    body = take(zero_cut(arr), max_len - 2).cast("array<bigint>")
    return pad_array(body, max_len, F.lit(PAD_ID).cast("bigint"))


def mask_of(n_real: Column, max_len: int) -> Column:
    """1 on the first ``n_real`` positions, 0 after, length ``max_len``."""
    return F.transform(F.sequence(F.lit(1), F.lit(max_len)),
                       lambda i: F.when(i <= n_real, F.lit(1)).otherwise(F.lit(0)))


def frame_cls_sep(tokens: ColumnOrName, max_len: int, cls="<s>", sep="</s>",
                  with_sep: bool = True) -> Column:
    """tokens[:max-2] framed as ``[CLS]+t+[SEP]`` (or ``[CLS]+t[:max-1]`` without SEP)."""
    t = _c(tokens)
    if with_sep:
        return F.concat(F.array(_lit(cls)), take(t, max_len - 2), F.array(_lit(sep)))
    return F.concat(F.array(_lit(cls)), take(t, max_len - 1))


def frame_cls_sep_mask(ids: ColumnOrName, max_len: int, cls_id: int, sep_id: int, pad_id: int,
                       with_sep: bool = True) -> Column:
    """Per field: ids framed, padded with ``pad_id`` and a 1/0 mask -> struct(ids, mask)."""
    cls, sep, pad = (F.lit(i).cast("bigint") for i in (cls_id, sep_id, pad_id))

    def padded(framed: Column) -> Column:
        return F.struct(pad_array(framed, max_len, pad).alias("ids"), mask_of(F.size(framed), max_len).alias("mask"))
    return once(once(_c(ids).cast("array<bigint>"), lambda t: frame_cls_sep(t, max_len, cls, sep, with_sep)), padded)


def context_prefix_from_mask(ids: ColumnOrName, mask: ColumnOrName) -> Column:
    """Recover a forced prefix: ids before the first 0 of the mask, minus the leading CLS."""
    p = F.array_position(_c(mask), F.lit(0))
    n = F.when(p > 0, p - 1).otherwise(F.size(_c(mask)))
    return safe_slice(ids, 2, n - 1)


def position_ids(length: ColumnOrName, max_len: int, left_pad: bool = False) -> Column:
    """1..len then zeros (or zeros then 1..len when left padded); a length above ``max_len`` is an error."""
    n = _c(length).cast("int")
    n = F.when(n > max_len, F.raise_error(F.concat(F.lit(f"length above {max_len}: "), n.cast("string")))).otherwise(n)
    pos = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    zeros = repeat(0, F.lit(max_len) - n)
    return F.concat(zeros, pos) if left_pad else F.concat(pos, zeros)


def length_mask(length: ColumnOrName, max_len: ColumnOrName) -> Column:
    """``sequence_mask``: i < len for i in 0..max_len-1 (max_len may be a column)."""
    m = _c(max_len).cast("int") if not isinstance(max_len, int) else F.lit(max_len)
    return F.when(m > 0, F.transform(F.sequence(F.lit(0), m - 1), lambda i: i < _c(length))) \
            .otherwise(F.array().cast("array<boolean>"))


def filter_pad(ids: ColumnOrName, pad=PAD_ID) -> Column:
    return F.filter(_c(ids), lambda x: x != _lit(pad))


def eos_cut(ids: ColumnOrName, eos=EOS_ID) -> Column:
    """Cut at the first EOS, EOS dropped."""
    return zero_cut(ids, eos)


def keep_through_eos(ids: ColumnOrName, eos=EOS_ID) -> Column:
    """Cut after the first EOS, EOS kept."""
    a = _c(ids)
    p = F.array_position(a, _lit(eos))
    return F.when(p > 0, safe_slice(a, 1, p)).otherwise(a)


def strip_prefix(ids: ColumnOrName, n_prefix: ColumnOrName) -> Column:
    """Drop a forced prefix of ``n`` tokens when the result is longer than it."""
    a, n = _c(ids), _c(n_prefix)
    return F.when(F.size(a) > n, safe_slice(a, n + 1, F.size(a) - n)).otherwise(a)


def ngram_windows(tokens: ColumnOrName, n: int) -> Column:
    """All contiguous n-grams of one order as ``\\u0001``-joined strings (empty if size<n)."""
    t = _c(tokens)
    if n == 1:
        return F.coalesce(t, F.array().cast("array<string>"))   # unigrams are the tokens themselves
    cnt = F.size(t) - F.lit(n) + 1
    return F.when(cnt > 0, F.transform(F.sequence(F.lit(1), cnt),
                                       lambda i: F.array_join(F.slice(t, i, F.lit(n)), "\u0001"))) \
            .otherwise(F.array().cast("array<string>"))


def ngram_ladder(tokens: ColumnOrName, max_n: int) -> list[Column]:
    """n-gram strings of orders 1..max_n, each order built from the previous one
    (``g_n[i] = g_{n-1}[i] + sep + t[i+n-1]``) with ``zip_with`` over shifted slices:
    no intermediate array per n-gram."""
    t = F.coalesce(_c(tokens), F.array().cast("array<string>"))
    out = [t]
    prev = t
    for n in range(2, max_n + 1):
        cnt = F.greatest(F.size(t) - F.lit(n - 1), F.lit(0))
        prev = F.zip_with(F.slice(prev, F.lit(1), cnt), F.slice(t, F.lit(n), cnt),
                          lambda a, b: F.concat(a, F.lit("\u0001"), b))
        out.append(prev)
    return out


def l2_normalize(vec: ColumnOrName, eps: float = 1e-12) -> Column:
    """Unit-length vector, divisor ``max(||v||, eps)``."""
    v = F.transform(_c(vec), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"), lambda acc, x: acc + x * x))
    return F.transform(v, lambda x: x / F.greatest(norm, F.lit(eps)))


def pair_vector_features(a: ColumnOrName, b: ColumnOrName, mode: str) -> Column:
    """``[a;b]``, ``[a;a-b]`` or ``[a;a*b]`` of two aligned vectors."""
    va = F.transform(_c(a), lambda x: x.cast("double"))
    vb = F.transform(_c(b), lambda x: x.cast("double"))
    if mode == "cat":
        return F.concat(va, vb)
    if mode == "diff":
        return F.concat(va, F.zip_with(va, vb, lambda x, y: x - y))
    if mode == "mul":
        return F.concat(va, F.zip_with(va, vb, lambda x, y: x * y))
    raise ValueError(f"unknown pair mode {mode!r}")


def ids_text(arr: ColumnOrName, sep: str = " ") -> Column:
    """Array of numbers as a joined string (comparable across engines)."""
    return F.array_join(F.transform(_c(arr), lambda x: x.cast("string")), sep)
