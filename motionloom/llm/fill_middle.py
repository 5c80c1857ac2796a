"""Fill-in-the-middle rewriting of texts, by pyarrow compute kernels over whole batches.

Every text is split into units (characters or lines); a batch becomes one list array of units.  It is
flattened with the numbers of its texts, each unit gets its ordinal within its text and from that its
role (prefix, middle or suffix); the units of each role are filtered, rebuilt into lists and joined,
and the three pieces of each text are joined with their marks in the order of its form.  No text is
handled on its own.

Draws come from the SHA-256 of ``seed:id``: its first two 32-bit groups give the cuts, the third
decides between plain and rewritten, the fourth between the two orders.  A text that is empty or
holds one of the marks stays as it is, so that ``restored`` always rebuilds it exactly.

Null texts are empty.  Rows without an id draw from the seed alone.  Repeated rows give repeated
rows, and nothing is shuffled.  Only the id and the text are read, so further columns cannot clash.
An empty table gives no rows.  A task holds about 40 bytes a unit of ``batch_chars`` characters or of
one text, if that is longer.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, id_text, sliced

#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
#: Forms and the order of their pieces: 0 prefix, 1 suffix, 2 middle.
ORDERS = {"psm": (0, 1, 2), "spm": (1, 0, 2)}
_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def unit_lists(texts: pa.StringArray, unit: str = "char") -> pa.ListArray:
    """Each text as the list of its units: code points, or lines with their line ends."""
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32, len(texts) + 1, texts.offset * 4)
    raw = np.frombuffer(data, np.uint8, offsets[-1]) if data is not None and offsets[-1] else np.zeros(0, np.uint8)
    raw = raw[offsets[0] :]
    begins = (raw & 0xC0) != 0x80 if unit == "char" else np.concatenate(([True], raw[:-1] == 10))[: len(raw)]
    bounds = offsets - offsets[0]
    begins[bounds[:-1][bounds[:-1] < bounds[1:]]] = True  # a text's first byte begins a unit
    starts = np.flatnonzero(begins).astype(np.int32)
    units = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts + offsets[0], offsets[-1]).astype(np.int32)), data)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, bounds).astype(np.int32)), units)


def draws(ids: pa.Array, seed: int) -> list[pa.Array]:
    """The first four 32-bit groups of the hash of every id."""
    heads = b"".join([hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids.to_pylist()])
    groups = np.frombuffer(heads, ">u4").reshape(-1, 4).astype(np.int64)
    return [pa.array(groups[:, k]) for k in range(4)]


def _modulo(x: pa.Array, n: pa.Array | int) -> pa.Array:
    return pc.subtract(x, pc.multiply(pc.divide(x, n), n))


def rewrite(ids: pa.Array, texts: pa.StringArray, seed: int, plain: int, spm: int, unit: str, marks: tuple[str, str, str]) -> dict[str, pa.Array]:
    """The columns n, form, prefix_chars, middle_chars and output of a batch."""
    units = unit_lists(texts, unit)
    n = pc.cast(pc.list_value_length(units), pa.int64())
    h1, h2, h3, h4 = draws(ids, seed)
    one, two = (_modulo(h, pc.add(n, 1)) for h in (h1, h2))
    first, second = pc.min_element_wise(one, two), pc.max_element_wise(one, two)

    parent = pc.list_parent_indices(units)
    flat = pc.list_flatten(units)
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.take(pc.cast(units.offsets[:-1], pa.int64()), parent))
    in_prefix, before_end = pc.less(ordinal, pc.take(first, parent)), pc.less(ordinal, pc.take(second, parent))

    def joined(role: pa.Array) -> tuple[pa.Array, pa.Array]:
        """The units of a role as one text a row, and their characters."""
        own = pc.filter(parent, role)
        bounds = np.searchsorted(own.to_numpy(), np.arange(len(texts) + 1)).astype(np.int32)
        piece = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), pc.filter(flat, role)), "")
        return piece, pc.cast(pc.utf8_length(piece), pa.int64())

    (prefix, prefix_chars), (middle, middle_chars) = joined(in_prefix), joined(pc.and_(pc.invert(in_prefix), before_end))
    suffix, _ = joined(pc.invert(before_end))
    marked = pc.equal(n, 0)
    for mark in marks:
        marked = pc.or_(marked, pc.match_substring(texts, mark))
    stays = pc.or_(marked, pc.greater_equal(_modulo(h3, 100), plain))
    form = pc.if_else(stays, "plain", pc.if_else(pc.less(_modulo(h4, 100), spm), "spm", "psm"))
    pieces = [pc.binary_join_element_wise(mark, piece, "") for mark, piece in zip(marks, (prefix, suffix, middle), strict=True)]
    output = texts
    for name, order in ORDERS.items():
        output = pc.if_else(pc.equal(form, name), pc.binary_join_element_wise(*[pieces[k] for k in order], ""), output)
    none = pa.scalar(None, pa.int64())
    return {"n": n, "form": form, "prefix_chars": pc.if_else(stays, none, prefix_chars), "middle_chars": pc.if_else(stays, none, middle_chars), "output": output}


def fill_middle(docs: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20, unit: str = "char", marks: tuple[str, str, str] = MARKS, batch_chars: int = 250_000) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output of every document.

    Of 100 draws those from ``plain_from`` on stay plain, and of the others those below ``spm_below``
    put the suffix first.
    """
    if unit not in ("char", "line"):
        raise ValueError("units are char or line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, chars=batch_chars):
            made = rewrite(batch.column(0), batch.column(1), seed, plain_from, spm_below, unit, marks)
            yield pa.RecordBatch.from_arrays([batch.column(0), *made.values()], ["doc_id", *made])
        give_back()

    return id_text(docs).mapInArrow(run, _SCHEMA)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of, from the output and its form alone."""
    parts = F.split(output, "|".join(f"\\Q{m}\\E" for m in marks) if not any("\\E" in m for m in marks) else "|".join(map(re.escape, marks)), -1)
    text = output
    for name, order in ORDERS.items():
        place = {k: at + 1 for at, k in enumerate(order)}  # nothing stands before the first mark
        text = F.when(form == name, F.concat(*[parts[place[k]] for k in (0, 2, 1)])).otherwise(text)
    return text
