"""Fill-in-middle: a text is cut into prefix, middle and suffix and written in another order.

Cuts fall between tokens (runs of A-Z letters, or single other characters), at
places that hashes of the document's id choose. The work is on UTF-8 bytes, all
texts of a slice at once: a byte begins a token unless it continues a character
or a run of letters, so a cut is looked up among token starts. Code points come
from a sparse exception index, which holds the multibyte characters only, by
place, with the bytes they take beyond one: between two of them, and in a text
without any, a code point and its byte differ by a constant.

Forms: ``plain`` is the text itself, ``psm`` is <P>prefix<S>suffix<M>middle,
``spm`` is <S>suffix<P>prefix<M>middle.

Cases: a null or empty text is plain, with no tokens; so is a text that contains
a mark; lengths are null for plain; texts of any length are cut whole; repeated
rows, and texts with equal ids and token counts, are cut alike; a null id hashes
as an empty one; an empty table gives no rows; other columns keep their names
and values, whatever they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.llm.common import set_aside
from paperlake.llm.utf8 import slices, text_bytes

# The marks and the shares, in a hundred, of plain and of spm among the rest.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_PERCENT, SPM_PERCENT = 10, 20
#: Bytes of texts that a task works on at a time.
SLICE_BYTES = 4_000_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class Exceptions:
    """Multibyte characters of a byte array: their places in bytes and in code points, and excess bytes up to each."""

    def __init__(self, data: np.ndarray):
        lead = np.flatnonzero(data >= 0xC0)
        size = np.ones(len(lead), np.int64) + (data[lead] >= 0xC0) + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
        self.byte = lead
        self.excess = np.concatenate([[0], np.cumsum(size - 1)])
        self.char = lead - self.excess[:-1]

    def chars(self, byte: np.ndarray) -> np.ndarray:
        """Code points before each byte that begins a character."""
        return byte - self.excess[np.searchsorted(self.byte, byte, side="left")]

    def bytes(self, char: np.ndarray) -> np.ndarray:
        """Bytes before each code point."""
        return char + self.excess[np.searchsorted(self.char, char, side="left")]


def token_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bytes at which a token begins; ``at`` says where texts do."""
    letter = _LETTER[data]
    begins = (data & 0xC0) != 0x80
    begins[1:] &= ~(letter[1:] & letter[:-1])
    begins[at[:-1][at[:-1] < at[1:]]] = True
    return np.flatnonzero(begins)


def _parts(texts: pa.Array, first: np.ndarray, second: np.ndarray):
    """Tokens, cuts in bytes and sizes in code points of each text of a slice."""
    data, at = text_bytes(texts)
    starts = token_starts(data, at)
    before = np.searchsorted(starts, at)
    n = np.diff(before)
    cut = np.sort(np.stack([first % (n + 1), second % (n + 1)]), axis=0)
    ends = np.append(starts, len(data))
    # The token after the last one of a text would begin where the text ends.
    byte = np.where(cut == n, at[1:], ends[np.minimum(before[:-1] + cut, len(starts))])
    chars = Exceptions(data).chars(np.stack([at[:-1], byte[0], byte[1]]))
    return data, at, n, byte, chars


def _written(texts: pa.Array, numbers: list[np.ndarray], plain_percent: int, spm_percent: int) -> pa.StructArray:
    h1, h2, h3, h4 = numbers
    data, at, n, (one, two), (zero, first, second) = _parts(texts, h1, h2)
    whole = data.tobytes()
    marks = [mark.encode() for mark in (PREFIX, SUFFIX, MIDDLE)]
    forms, out, plain = [], [], np.zeros(len(n), bool)
    for i, (a, b, c, e) in enumerate(zip(at[:-1].tolist(), one.tolist(), two.tolist(), at[1:].tolist())):
        text = whole[a:e]
        if not text or h3[i] % 100 >= 100 - plain_percent or any(mark in text for mark in marks):
            plain[i] = True
            forms.append("plain")
            out.append(text)
        elif h4[i] % 100 < spm_percent:
            forms.append("spm")
            out.append(b"".join([marks[1], whole[c:e], marks[0], whole[a:b], marks[2], whole[b:c]]))
        else:
            forms.append("psm")
            out.append(b"".join([marks[0], whole[a:b], marks[1], whole[c:e], marks[2], whole[b:c]]))
    return pa.StructArray.from_arrays(
        [
            pa.array(n, pa.int64()), pa.array(forms, pa.string()),
            pa.array(first - zero, pa.int64(), mask=plain), pa.array(second - first, pa.int64(), mask=plain),
            pa.array(out, pa.binary()).cast(pa.string(), safe=False),
        ],
        ["n", "form", "prefix_chars", "middle_chars", "output"],
    )


def _numbers(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def infilled(
    docs: DataFrame,
    *,
    column: str = "infill",
    seed: int = 1,
    plain_percent: int = PLAIN_PERCENT,
    spm_percent: int = SPM_PERCENT,
) -> DataFrame:
    """All columns of ``docs`` (doc_id, text) and a struct: n, form, prefix_chars, middle_chars and the output text."""
    rows, names = set_aside(docs)
    key, text = (F.col(f"_in{docs.columns.index(name)}") for name in ("doc_id", "text"))

    @F.arrow_udf("n long, form string, prefix_chars long, middle_chars long, output string")
    def write(texts: pa.Array, h1: pa.Array, h2: pa.Array, h3: pa.Array, h4: pa.Array) -> pa.Array:
        numbers = [h.to_numpy(zero_copy_only=False) for h in (h1, h2, h3, h4)]
        sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        made = [
            _written(texts.slice(a, b - a), [h[a:b] for h in numbers], plain_percent, spm_percent)
            for a, b in slices(at, SLICE_BYTES)
        ]
        return pa.concat_arrays(made) if made else _written(texts, numbers, plain_percent, spm_percent)

    return rows.select(*names, write(text.cast("string"), *_numbers(key, seed)).alias(column))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    after = lambda value, mark: F.split_part(value, F.lit(mark), F.lit(2))
    until = lambda value, mark: F.split_part(value, F.lit(mark), F.lit(1))
    middle = after(output, MIDDLE)
    rest = until(output, MIDDLE)
    psm = F.concat(until(after(rest, PREFIX), SUFFIX), middle, after(rest, SUFFIX))
    spm = F.concat(after(rest, PREFIX), middle, until(after(rest, SUFFIX), PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, sizes, and digests of the output and of the text restored from it."""
    made = infilled(docs.select("doc_id", "text"), column="made").select("doc_id", "made.*")
    digest = lambda value: F.sha2(value.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
