"""SentencePiece encoding and decoding through a table of distinct marked words.

A piece of this vocabulary holds whitespace markers only at its start, so no merge
crosses the point between a non-marker and a marker. A text therefore falls into chunks
(a run of markers and the characters up to the next run) that the segmenter treats
independently. Each slab of texts collects its distinct chunks, hands only those its task's table
does not hold to the library, and joins ids and decoded strings back by position. The table has two
generations: a chunk met again moves to the young one, and when that is full the old one goes. So words
in use are segmented once per task, whatever the vocabulary; only rare ones may be again.

Defined results: a null text counts as empty; the empty text encodes to the end id alone and
decodes to the empty string; a literal U+2581 is the marker itself, as in the library;
repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh

MARKER = "▁"
_CHUNK = re.compile(" +[^ ]*")
#: One space, then printable ASCII and precomposed Latin letters, none of which the normaliser changes.
_PLAIN = re.compile("\x20[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
LINE = 64


class ChunkTable:
    """Distinct chunk -> (ids as int32 bytes, decoded text), bounded in entries and chunk length."""

    def __init__(self, model_path: str, max_entries: int = 80_000, max_chunk: int = 48):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.max_entries, self.max_chunk = max_entries, max_chunk
        # ids and texts apart: plain values in plain dicts cost the garbage collector nothing
        self.old: tuple[dict[str, bytes], dict[str, str]] = {}, {}
        self.young: tuple[dict[str, bytes], dict[str, str]] = {}, {}
        crossing = [p for i in range(self.sp.get_piece_size()) if MARKER in (p := self.sp.id_to_piece(i)).lstrip(MARKER)]
        if crossing:
            raise ValueError(f"pieces cross whitespace markers, e.g. {crossing[:3]}: the chunk table would not be exact")
        self.unknown = self.sp.unk_id()
        self.lone = self.sp.piece_to_id(MARKER)
        self.begins = np.array([self.sp.id_to_piece(i).startswith(MARKER) for i in range(self.sp.get_piece_size())])

    def segment(self, chunks: list[str]) -> None:
        """Puts ids and decoded text of each chunk into the young generation.

        Chunks of one space and characters that normalise to themselves go to the library side by side, in
        lines of ``LINE``: such a chunk has one piece that begins with a marker, its first, so the ids fall apart there.
        """
        to_ids, to_text = self.young
        plain = list(filter(_PLAIN.fullmatch, chunks))
        odd = [c for c in chunks if not _PLAIN.fullmatch(c)]
        lines = [plain[i : i + LINE] for i in range(0, len(plain), LINE)]
        # the library puts one marker before its input, so the first one is left out
        for line, ids in zip(lines, self.sp.encode(["".join(x)[1:] for x in lines], num_threads=1) if lines else ()):
            ids = np.array(ids, np.int32)
            begins = np.flatnonzero(self.begins[ids])
            if len(begins) != len(line) or (ids == self.unknown).any():
                odd += line
                continue
            data, cuts = ids.tobytes(), [*(4 * begins).tolist(), 4 * len(ids)]
            to_ids.update(zip(line, [data[lo:hi] for lo, hi in zip(cuts[:-1], cuts[1:])]))
            to_text.update(zip(line, line))
        encoded = self.sp.encode([c[1:] for c in odd], num_threads=1) if odd else []
        encoded = [e if c != " " else [self.lone] for c, e in zip(odd, encoded)]
        to_ids.update(zip(odd, [array("i", e).tobytes() for e in encoded]))
        to_text.update(zip(odd, [" " + d for d in self.sp.decode(encoded)] if odd else ()))

    def run(self, texts: list[str], end_id: int):
        """For each text its ids (int32 bytes) and the decoded string."""
        tail = array("i", [end_id]).tobytes() if end_id >= 0 else b""
        split = [_CHUNK.findall(" " + t.replace(MARKER, " ")) if t else [] for t in texts]
        to_ids, to_text = self.young
        missing = set().union(*split).difference(to_ids)
        again = missing.intersection(self.old[0])
        fresh = list(missing.difference(again))
        to_ids.update(zip(again, map(self.old[0].__getitem__, again)))
        to_text.update(zip(again, map(self.old[1].__getitem__, again)))
        self.segment(fresh)
        ids = [b"".join(map(to_ids.__getitem__, s)) + tail for s in split]
        back = ["".join(map(to_text.__getitem__, s))[1:] for s in split]
        for c in fresh:
            if len(c) > self.max_chunk:
                del to_ids[c], to_text[c]
        if len(to_ids) > self.max_entries // 2:
            self.old, self.young = self.young, ({}, {})
        return ids, back


def encode_decode(docs: DataFrame, model_path: str, keep: list[str], text_col: str = "text", slab_bytes: int = 1 << 20) -> DataFrame:
    """``keep`` columns (but for those of these names) plus ``ids`` array<int> (end id included, no start id) and ``decoded`` string."""
    bounded_batches(docs.sparkSession)
    kept = docs.select(*(k for k in keep if k.lower() not in ("ids", "decoded")))
    source = docs.select(*kept.columns, F.coalesce(F.col(text_col), F.lit("")).alias(fresh(kept, "_lt_text")))
    schema = kept.withColumn("ids", F.lit(None).cast("array<int>")).withColumn("decoded", F.lit(None).cast("string")).schema
    whole = slab_bytes

    def work(batches):
        table = ChunkTable(model_path)
        end = table.sp.eos_id()
        for batch in batches:
            at = 0
            column = batch.column(batch.num_columns - 1)
            while at < batch.num_rows:  # slabs bound what one step holds
                hi, size = at, 0
                texts = []
                while hi < batch.num_rows and (size < whole or hi == at):
                    texts.append(column[hi].as_py())
                    size += len(texts[-1])
                    hi += 1
                ids, back = table.run(texts, end)
                offsets = np.cumsum([0] + [len(b) // 4 for b in ids]).astype(np.int32)
                values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(ids))])
                piece = batch.slice(at, hi - at)
                arrays = [piece.column(i) for i in range(batch.num_columns - 1)]
                arrays += [pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
                at = hi

    return source.mapInArrow(work, schema)
