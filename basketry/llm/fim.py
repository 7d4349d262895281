"""Fill-in-the-middle by piece tables.

A document is a table of descriptors (buffer, start, end) over two immutable
buffers: its text in UTF-8 and the sentinels. Cutting splits descriptors,
an arrangement permutes them together with those of the sentinels, the inverse
permutation restores the document, and hashes and outputs are streamed from
the descriptors; the text itself is never edited.

The units of a cut are lines, a line's end included. The draws come from the
SHA-256 of ``seed:doc_id``, so a document is cut alike wherever and however
often it is read. ``psm`` is <P>prefix<S>suffix<M>middle, ``spm``
<S>suffix<P>prefix<M>middle, ``plain`` the text as it is.

Every row is on its own: one pass over the rows, no shuffle, one text in
memory at a time.

Defined results: a null text counts as empty; an empty text, or one that holds
a sentinel, stays plain with null ``prefix_chars`` and ``middle_chars``; a null
id is hashed as an empty one; rows that repeat an id are kept, cut by the same
draws; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import map_arrow

#: The sentinels of prefix, suffix and middle.
MARKS = (b"<P>", b"<S>", b"<M>")
TEXT, MARK = 0, 1
#: Of the descriptors prefix, middle, suffix and the three sentinels (0 to 5),
#: the order in which a form puts them.
FORMS = {"psm": (3, 0, 4, 2, 5, 1), "spm": (4, 2, 3, 0, 5, 1)}
#: Bytes of output texts in a batch, about.
BATCH = 8 << 20


def check_marks(marks=MARKS) -> None:
    """Sentinels that overlap could not be told apart in an output."""
    for a in marks:
        for b in marks:
            if not a or (a != b and a in b) or any(
                    a.endswith(b[:n]) for n in range(1, min(len(a), len(b)))):
                raise ValueError(f"sentinels overlap: {a!r}, {b!r}")


class Pieces:
    """Descriptors (buffer number, start, end) over immutable buffers."""

    __slots__ = ("buffers", "rows")

    def __init__(self, buffers: tuple[bytes, ...], rows: list[tuple[int, int, int]]):
        self.buffers, self.rows = buffers, rows

    @classmethod
    def of(cls, text: bytes, marks=MARKS) -> Pieces:
        """The whole text, one descriptor; the sentinels are the other buffer."""
        return cls((text, b"".join(marks)), [(TEXT, 0, len(text))])

    def cut(self, *at: int) -> Pieces:
        """Descriptors split at the growing offsets ``at`` of what they hold; a
        piece may be empty."""
        out, done, cuts = [], 0, list(at)
        for buffer, lo, hi in self.rows:
            end = done + hi - lo
            while cuts and cuts[0] <= end:
                mid = lo + cuts.pop(0) - done
                out.append((buffer, lo, mid))
                done, lo = done + mid - lo, mid
            out.append((buffer, lo, hi))
            done = end
        return Pieces(self.buffers, out)

    def with_marks(self, marks=MARKS) -> Pieces:
        """The descriptors, then one for each sentinel."""
        ends = np.cumsum([0] + [len(m) for m in marks]).tolist()
        return Pieces(self.buffers, [*self.rows, *((MARK, a, b) for a, b in zip(ends, ends[1:]))])

    def arranged(self, order) -> Pieces:
        return Pieces(self.buffers, [self.rows[i] for i in order])

    def first(self, n: int) -> Pieces:
        return Pieces(self.buffers, self.rows[:n])

    def stream(self):
        """What the descriptors hold, without a copy."""
        views = [memoryview(b) for b in self.buffers]
        for buffer, lo, hi in self.rows:
            yield views[buffer][lo:hi]

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for part in self.stream():
            digest.update(part)
        return digest.hexdigest()

    def join(self) -> bytes:
        return b"".join(self.stream())


def inverse(order) -> list[int]:
    """The permutation that takes an arrangement back."""
    back = [0] * len(order)
    for at, i in enumerate(order):
        back[i] = at
    return back


def draws(doc_id, seed: int = 7) -> tuple[int, int, int, int]:
    """The first four 8-digit groups of the SHA-256 of ``seed:doc_id``."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4], "big") for i in range(0, 16, 4))


def line_ends(text: bytes) -> np.ndarray:
    """Offsets at which the lines ``[^\\n]*\\n|[^\\n]+`` end."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    if text and not text.endswith(b"\n"):
        ends = np.append(ends, len(text))
    return ends


def chars(part: memoryview) -> int:
    """Code points of valid UTF-8: the bytes that begin one."""
    return int((np.frombuffer(part, np.int8) >= -64).sum())


def arrange(text: bytes, doc_id, seed: int = 7, rate: int = 100, spm: int = 50, marks=MARKS):
    """(number of lines, form, arranged pieces, prefix chars, middle chars)."""
    ends = line_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    whole = Pieces.of(text, marks)
    if not text or any(m in text for m in marks) or h3 % 100 >= rate:
        return n, "plain", whole, None, None
    form = "spm" if h4 % 100 < spm else "psm"
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    parts = whole.cut(*(int(ends[u - 1]) if u else 0 for u in (a, b)))
    prefix, middle, _ = parts.stream()
    return (n, form, parts.with_marks(marks).arranged(FORMS[form]), chars(prefix), chars(middle))


def restored(output: bytes, form: str, marks=MARKS) -> Pieces:
    """The document as pieces of an output, by the inverse of the form's
    permutation; only the output and its form are needed."""
    if form == "plain":
        return Pieces((output,), [(TEXT, 0, len(output))])
    order, at = FORMS[form], 0
    rows: list[tuple[int, int, int]] = []
    for place in range(0, len(order), 2):
        mark = marks[order[place] - 3]
        found = output.find(mark, at)
        if found < 0 or (place == 0 and found != 0):
            raise ValueError(f"sentinel {mark!r} is missing")
        if place:
            rows.append((TEXT, at, found))
        at = found + len(mark)
        rows.append((TEXT, found, at))
    rows.append((TEXT, at, len(output)))
    return Pieces((output,), rows).arranged(inverse(order)).first(3)


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50,
              texts: bool = True, marks=MARKS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n (lines), form, prefix_chars,
    middle_chars, output_sha256, restored_sha256 (of the text rebuilt from the
    output and the form) and, with ``texts``, output. ``rate`` of 100 documents
    are cut, ``spm`` of 100 of those as spm."""
    check_marks(marks)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256",
             "restored_sha256"] + ["output"] * texts
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [
        pa.string()] * texts

    def run(batches):
        for b in batches:
            ids, rows, size, lo = b.column(0), [], 0, 0

            def emit(hi):
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                return pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *cols], names)

            for i, t in enumerate(b.column(1)):
                text = t.as_buffer().to_pybytes() if t.is_valid else b""
                n, form, pieces, prefix, middle = arrange(text, ids[i].as_py(), seed, rate, spm,
                                                          marks)
                output = pieces.join()
                rows.append((n, form, prefix, middle, pieces.sha256(),
                             restored(output, form, marks).sha256(), *[output] * texts))
                size += len(output) * texts
                if size >= BATCH:
                    yield emit(i + 1)
                    rows, size, lo = [], 0, i + 1
            if rows:
                yield emit(b.num_rows)

    return map_arrow(docs.select("doc_id", F.col("text").cast("string").alias("text")), run,
                     f"doc_id {kind}, n bigint, form string, prefix_chars bigint, "
                     "middle_chars bigint, output_sha256 string, restored_sha256 string"
                     + ", output string" * texts)


def restore(outputs: DataFrame, marks=MARKS) -> DataFrame:
    """doc_id, text: the documents rebuilt from (doc_id, output, form)."""
    kind = outputs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = [restored(o.as_buffer().to_pybytes(), f.as_py(), marks).join()
                     for o, f in zip(b.column(1), b.column(2))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    return map_arrow(outputs.select("doc_id", "output", "form"), run,
                     f"doc_id {kind}, text string")


def sql() -> str:
    """The transformation of ``documents`` as DuckDB SQL."""
    part = lambda i: f"('0x' || substr(hex, {8 * i + 1}, 8))::UBIGINT"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u,
    sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex FROM documents),
h AS (SELECT doc_id, text, u, len(u) AS n, {part(0)} % (len(u) + 1) AS c1,
    {part(1)} % (len(u) + 1) AS c2, {part(2)} AS h3, {part(3)} AS h4 FROM t),
c AS (SELECT doc_id, text, n, CASE WHEN text = '' OR contains(text, '<P>')
      OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
    WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1:least(c1, c2)], '') AS prefix,
    array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS middle,
    array_to_string(u[greatest(c1, c2) + 1:], '') AS suffix FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text
    WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM c"""
