"""SentencePiece (merge type) encoding and decoding, exact, by backtracking.

A merge encoding is the only cut of a text into pieces in which every adjacent pair is stable: merging the pair's
characters again gives the same two pieces. So the encoder takes the longest piece that starts at a position (all
matches come from one Aho-Corasick pass), checks it against the piece before by re-merging that pair (remembered per
pair), tries the next shorter piece that it begins with, and steps back when none fits; a bitfield holds positions from which no
cut exists, so that none is tried twice. Characters without a piece become byte pieces.

Pieces never contain a space mark after another character (checked when the model is loaded), and characters that
occur in no longer piece never merge, so a text falls apart there exactly; encodings of these parts are remembered in
a bounded table. Defined results: null text is the empty text (just the end id; decodes to the empty text). Repeated
rows get equal results; texts of any length are encoded whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from clausegraph.llm.runtime import held, table

MARK = "▁"
#: Bounds of the tables each Python worker keeps, in two generations: what is not used again goes with the older one.
PARTS, PAIRS = 250_000, 250_000
#: Ids that a worker gathers before it hands rows on.
FLUSH = 500_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    """Encoder and decoder for one model file; only the piece list and scores are taken from the library."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [lib.id_to_piece(i) for i in range(lib.vocab_size())]
        special = {i for i in range(lib.vocab_size()) if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i)}
        self.end, self.unknown = lib.eos_id(), lib.unk_id()
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in special if lib.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i in special if lib.is_control(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.score = {p: lib.get_score(i) for p, i in self.ids.items()}
        self.found = ahocorasick.Automaton()
        for piece in self.ids:
            self.found.add_word(piece, len(piece))
        self.found.make_automaton()
        #: Length of the longest piece that a piece begins with; 1 if there is none.
        self.shorter = {p: next((n for n in range(len(p) - 1, 1, -1) if p[:n] in self.ids), 1) for p in self.ids if len(p) > 1}
        self.same = {p: p for p in self.ids}
        self.name = list(map(str, range(len(self.pieces))))
        self.surface = [None if i in special else p.replace(MARK, " ") for i, p in enumerate(self.pieces)]
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in joined)
        whole = any(MARK in p.lstrip(MARK) for p in self.ids)
        #: Parts of a text as it comes, with blanks or space marks: the table's keys are mostly their own surface, too.
        self.parts = re.compile(r"[\s\S]+" if whole else f"[{alone}]|[ {MARK}]+[^ {MARK}{alone}]*|[^ {MARK}{alone}]+" if alone else f"[ {MARK}]+[^ {MARK}]*|[^ {MARK}]+")
        #: Whether a piece's characters merge to it again.
        self.whole: dict[str, bool] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.old_pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, tuple[str, int, str]] = {}
        self.old_known: dict[str, tuple[str, int, str]] = {}

    def merge(self, text: str) -> list[str]:
        """Merge by definition: always the adjacent pair with the best score, the leftmost of equals."""
        parts, score = list(text), self.score
        worst = -math.inf
        made = [score.get(a + b, worst) for a, b in itertools.pairwise(parts)]  # score of each adjacent pair's merge
        while made and (best := max(made)) > worst:
            at = made.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del made[at]
            if at:
                made[at - 1] = score.get(parts[at - 1] + parts[at], worst)
            if at < len(made):
                made[at] = score.get(parts[at] + parts[at + 1], worst)
        return parts

    def stable(self, left: str, right: str) -> bool:
        """Whether merging the two pieces' characters again gives the two; remembered in ``pairs``."""
        if len(self.pairs) >= PAIRS:
            self.old_pairs = self.pairs.copy()
            self.pairs.clear()
        known = self.old_pairs.get((left, right))
        key = self.same.get(left, left), self.same.get(right, right)  # no copies of the pieces' strings
        known = self.pairs[key] = self.merge(left + right) == [left, right] if known is None else known
        return known

    def cut(self, text: str) -> list[str]:
        """The merge encoding of ``text`` as strings, by backtracking."""
        if text in self.ids:
            if (whole := self.whole.get(text)) is None:
                whole = self.whole[text] = self.merge(text) == [text]
            if whole:
                return [text]
        size, shorter, stable = len(text), self.shorter, self.stable
        known = self.pairs.get
        longest = {last + 1 - length: length for last, length in self.found.iter(text)}  # ends ascend: the longest stays
        failed: bytearray | None = None
        out: list[str] = []
        at, left, length = 0, "", longest.get(0, 1)
        while at < size:
            while length:
                piece = text[at : at + length]
                end = at + length
                if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                    fits = not left or known((left, piece))
                    if fits or fits is None and stable(left, piece):
                        break
                length = shorter.get(piece, 0)
            if length:
                out.append(piece)
                at, left = end, piece
                length = longest.get(at, 1)
            else:
                failed = failed or bytearray(size // 8 + 1)
                failed[at >> 3] |= 1 << (at & 7)
                back = out.pop()
                at -= len(back)
                left = out[-1] if out else ""
                length = shorter.get(back, 0)
        return out

    def _part(self, part: str) -> tuple[str, int, str]:
        if (done := self.known.get(part) or self.old_known.get(part)) is not None:
            self.known[part] = done
            return done
        cut = self.cut(part.replace(" ", MARK))
        ids = list(map(self.ids.get, cut))
        if None in ids:
            ids = [j for piece, i in zip(cut, ids, strict=True) for j in ([i] if i is not None else [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown])]
        if len(self.known) >= PARTS:
            self.old_known, self.known = self.known, {}
        plain = self.plain(ids)
        done = (" ".join([self.name[i] for i in ids]), len(ids), part if plain == part else plain)
        if len(part) <= 64:
            self.known[part] = done
        return done

    def plain(self, ids: list[int]) -> str:
        """Surface text of ids, with its leading space mark still there as a space."""
        if None not in (found := [self.surface[i] for i in ids]):
            return "".join(found)
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            if i not in self.silent:
                out.append(" ⁇ " if i == self.unknown else self.pieces[i].replace(MARK, " "))
        out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.plain(ids)
        return text.removeprefix(" ")

    def encode_parts(self, text: str) -> list[tuple[str, int, str]]:
        if not text:
            return []
        known, made = self.known.get, self._part
        return [known(p) or made(p) for p in self.parts.findall(" " + text)]

    def encode(self, text: str) -> list[int]:
        return [*(int(i) for p in self.encode_parts(text) for i in p[0].split()), self.end]


def codec(path: str) -> Codec:
    """One codec per Python worker."""
    return held(("codec", path), lambda: Codec(path))


def encode(docs: DataFrame, path: str | None = None, keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """``docs(..., text)`` -> kept columns and n_tokens, ids_sha256, decoded_sha256 (with_ids: also the ids), row by row."""
    path = path or default_path()
    keep = keep or ["doc_id"]
    source = docs.select(*dict.fromkeys([*keep, "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        end = (str(own.end), 1, "")
        for batch in batches:
            n, ids_sha, text_sha, ids, begin = [], [], [], array("i"), 0
            for at, value in enumerate(batch.column("text")):
                named, counts, plain = zip(*own.encode_parts(value.as_py() or ""), end, strict=True)
                line = " ".join(named)
                n.append(sum(counts))
                ids_sha.append(hashlib.sha256(line.encode()).hexdigest())
                text_sha.append(hashlib.sha256("".join(plain).removeprefix(" ").encode()).hexdigest())
                if with_ids:
                    ids.extend(map(int, line.split()))
                if len(ids) >= FLUSH or at + 1 == len(batch):
                    more = [pa.ListArray.from_arrays(pa.array([0, *itertools.accumulate(n)], pa.int32()), pa.array(np.frombuffer(ids, np.int32)))] if with_ids else []
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(begin, len(n)) for c in keep), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha), *more], names=[*keep, *names])
                    n, ids_sha, text_sha, ids, begin = [], [], [], array("i"), at + 1

    names = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]
    types = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "n_tokens long, ids_sha256 string, decoded_sha256 string", *(["ids array<int>"] if with_ids else [])])
    return source.mapInArrow(run, schema)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


QUERIES = {"op2_sentencepiece": op2_sentencepiece}
SQL: dict[str, str] = {}
