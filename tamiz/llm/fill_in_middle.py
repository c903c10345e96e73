"""Fill-in-middle: a text's units are cut into prefix, middle and suffix, and put into another order between sentinels.

One scan runs a table-driven automaton over the bytes. Its states know whether a character goes on, whether the last bytes
are white space or a word, and how much of a sentinel has been read; every transition emits whether a character begins, whether
a unit ended before this byte, and whether a sentinel ended with it. The emissions are counted for each document. A second pass
finds the bytes of the cuts among the emitted ends of units. A state depends on the last three bytes only, so many
slices of a block are scanned in step, each from a few bytes before its start, with the result of one scan from the front.

Units: white space and the word behind it, and white space at the end. Null text is empty; an empty text, one with a
sentinel in it, and one by its own numbers stays plain. The numbers come from the sha256 of a seed and the doc_id; a null
doc_id counts as empty there. Repeated rows are cut alike. Bytes that are no UTF-8 pass as they are: each byte that
doesn't continue a character begins one. Texts of any length are scanned in linear time and memory. Extra columns
are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SEPARATOR, blocks, read, texts_of

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: A byte that no UTF-8 text has ends every document in the scanned stream.
END = 0xFF
START, SPACE, WORD, OPEN, NAMED, ONE_MORE, TWO_MORE, THREE_MORE = range(8)
CHARACTER, UNIT, SENTINEL = 1, 2, 4
#: Bytes that a slice reads before its own, and a slice's own length.
BEFORE, SLICE = 4, 512


def automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, emission) by state * 256 + byte."""
    goes, emits = np.zeros((8, 256), np.uint8), np.zeros((8, 256), np.uint8)
    for state in range(8):
        for b in range(256):
            in_word, continues = state not in (START, SPACE), 0x80 <= b < 0xC0
            if b == END:
                goes[state, b], emits[state, b] = START, UNIT * (state != START)
            elif SEPARATOR[b]:
                goes[state, b], emits[state, b] = SPACE, CHARACTER + UNIT * in_word
            elif continues:
                goes[state, b] = state - 1 if state > ONE_MORE else WORD
            elif b < 0x80:
                emits[state, b] = CHARACTER
                if b == ord("<"):
                    goes[state, b] = OPEN
                elif state == OPEN and b in (PREFIX[1], SUFFIX[1], MIDDLE[1]):
                    goes[state, b] = NAMED
                else:
                    goes[state, b] = WORD
                    emits[state, b] += SENTINEL * (state == NAMED and b == ord(">"))
            else:
                goes[state, b], emits[state, b] = (THREE_MORE if b >= 0xF0 else TWO_MORE if b >= 0xE0 else ONE_MORE), CHARACTER
    return goes.reshape(-1), emits.reshape(-1)


GOES, EMITS = automaton()


def scanned(stream: np.ndarray, length: int = SLICE) -> np.ndarray:
    """The emission at every byte of a stream of documents, each followed by END."""
    n = len(stream)
    rows = -(-n // length)
    # Column k holds the bytes of one slice, and above them those before it; the first slice has ENDs there.
    padded = np.full(BEFORE + rows * length, END, np.uint8)
    padded[BEFORE:BEFORE + n] = stream
    steps = np.lib.stride_tricks.as_strided(padded, (BEFORE + length, rows), (1, length))
    state, out = np.zeros(rows, np.intp), np.empty((length, rows), np.uint8)
    for t in range(BEFORE + length):
        at = (state << 8) + steps[t]
        if t >= BEFORE:
            out[t - BEFORE] = EMITS[at]
        state = GOES[at].astype(np.intp)
    return out.T.reshape(-1)[:n]


def cut(data: np.ndarray, off: np.ndarray, h: np.ndarray, middle_percent: int, swap_percent: int) -> Iterator[tuple]:
    """(units, form, prefix_chars, middle_chars, output) of every document. h: its four numbers in a row."""
    m = len(off) - 1
    stream = np.insert(data, off[1:], END)
    off = off + np.arange(m + 1)
    emitted = scanned(stream)
    ends = np.flatnonzero(emitted & UNIT)
    # The emission at a document's END belongs to it, so that each document has its own range of ends.
    first = np.searchsorted(ends, off)
    units = np.diff(first)
    sentinels = np.r_[0, np.cumsum((emitted & SENTINEL) > 0)]
    marked = sentinels[off[1:]] > sentinels[off[:-1]]
    chars = np.r_[0, np.cumsum(emitted & CHARACTER)]
    x, y = h[:, 0] % (units + 1), h[:, 1] % (units + 1)
    plain = (units == 0) | marked | (h[:, 2] % 100 >= middle_percent)
    swapped = h[:, 3] % 100 < swap_percent
    for d in range(m):
        begin, end, n = int(off[d]), int(off[d + 1]) - 1, int(units[d])
        if plain[d]:
            yield n, "plain", None, None, stream[begin:end].tobytes()
            continue
        places = [begin if k == 0 else int(ends[first[d] + k - 1]) for k in sorted((int(x[d]), int(y[d])))]
        prefix, middle, suffix = (stream[a:b].tobytes() for a, b in zip([begin, *places], [*places, end], strict=True))
        counts = (int(chars[places[0]] - chars[begin]), int(chars[places[1]] - chars[places[0]]))
        if swapped[d]:
            yield n, "spm", *counts, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
        else:
            yield n, "psm", *counts, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def fill_in_middle(docs: DataFrame, seed: str = "42", middle_percent: int = 50, swap_percent: int = 80) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every row of docs(doc_id, text, ...)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = texts_of(batch)
            h = np.stack([batch.column(f"h{k}").to_numpy() for k in (1, 2, 3, 4)], axis=1)
            for i, j in blocks(off):
                n, form, prefix, middle, output = zip(*cut(data[off[i]:off[j]], off[i:j + 1] - off[i], h[i:j], middle_percent, swap_percent), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).view(pa.string())],
                                                 ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select("doc_id", "text", *numbers).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text behind an output: what stands between its first sentinels, in the text's order. Nothing but output and form is used."""
    def between(one: str, other: str) -> tuple[Column, Column, Column]:
        i, j = F.locate(one, output), F.locate(other, output)
        return output.substr(F.lit(4), i - 4), output.substr(i + 3, j - i - 3), output.substr(j + 3, F.length(output))

    prefix, suffix, middle = between("<S>", "<M>")
    suffix2, prefix2, middle2 = between("<P>", "<M>")
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP13_SQL = r"""
with t as (select doc_id, coalesce(text, '') as x, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u, sha256(concat('42:', doc_id)) as s from documents),
h as (select doc_id, x, u, len(u) as n, cast(concat('0x', substr(s, 1, 8)) as bigint) as h1, cast(concat('0x', substr(s, 9, 8)) as bigint) as h2, cast(concat('0x', substr(s, 17, 8)) as bigint) as h3, cast(concat('0x', substr(s, 25, 8)) as bigint) as h4 from t),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
case when x = '' or contains(x, '<P>') or contains(x, '<S>') or contains(x, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from h),
p as (select doc_id, n, x, form, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:n], '') as s from c)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
sha256(case form when 'psm' then concat('<P>', p, '<S>', s, '<M>', m) when 'spm' then concat('<S>', s, '<P>', p, '<M>', m) else x end) as output_sha256, sha256(x) as restored_sha256 from p"""
