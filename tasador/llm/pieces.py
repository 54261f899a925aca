"""Exact merge-type sub-word encoding by backtracking, and decoding.

A merge encoding of a text is the one sequence of pieces in which every two
neighbours stay apart when only the two are merged again. So pieces are tried
from the left, longest first; a piece that does not get on with its left
neighbour gives way to the next shorter one, and a position where nothing fits
is marked in a bitfield and never entered again. All pieces that begin anywhere
in a stretch come from one Aho-Corasick pass.

Pieces never cross from a character to a following blank, nor over characters
outside the vocabulary (those become bytes), so a text is cut there and short
stretches are remembered per worker process.

Rows: a null text counts as empty (an end id only); other columns are ignored;
repeated rows are encoded each by itself; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import pairwise

import ahocorasick
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
REMEMBERED = 400_000
REMEMBERED_LENGTH = 48


class _Memo(dict):
    """A dict that fills itself and starts anew when it has become large."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[key] = self.make(key)
        return value


class PieceCoder:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end, self.ids, self.rank, self.bytes_ids, self.surface = model.eos_id(), {}, {}, {}, []
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:-1], 16)
                self.bytes_ids[value] = i
                self.surface.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i):
                self.surface.append(b"")
            else:
                self.ids[piece] = i
                self.rank[piece] = -model.get_score(i)
                self.surface.append(piece.replace(BLANK, " ").encode())
        self.surface_of_text = {str(i): s for i, s in enumerate(self.surface)}
        letters = set("".join(self.ids))
        if any(BLANK in piece.lstrip(BLANK) for piece in self.ids):
            raise ValueError("pieces with a blank inside cannot be cut at blanks")
        self.known = re.compile(f"[{''.join(map(re.escape, sorted(letters)))}]+|.", re.S)
        self.letters = letters
        self.find = ahocorasick.Automaton()
        for piece in self.ids:
            self.find.add_word(piece, (piece, len(piece)))
        self.find.make_automaton()
        self.cut = re.compile(self._cuts())
        self.remembered = _Memo(self._as_text)
        self.together = _Memo(self._stay_apart)

    def _cuts(self) -> str:
        """Where no piece reaches over: before blanks, at line ends, and from a letter to some marks."""
        after_letter = {b for piece in self.ids for a, b in pairwise(piece) if a.isalpha()}
        alpha = "".join(c for c in sorted(self.letters) if c.isalpha())
        apart = re.escape("".join(c for c in sorted(self.letters - after_letter) if not c.isalpha() and c != BLANK))
        return f"{BLANK}*[{alpha}]+(?![^{apart}{BLANK}\\n])|{BLANK}*[^{BLANK}\\n]+|{BLANK}+|\\n"

    def merge(self, text: str) -> list[str]:
        """Merge the best-ranked neighbours, leftmost first, until none can be merged."""
        rank, never = self.rank.get, float("inf")
        parts = list(text)
        ranks = [rank(a + b, never) for a, b in pairwise(parts)]
        while ranks and (best := min(ranks)) != never:
            i = ranks.index(best)
            joined = parts[i] = parts[i] + parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] + joined, never)
            if i < len(ranks):
                ranks[i] = rank(joined + parts[i + 1], never)
        return parts

    def _stay_apart(self, pair: tuple[str, str]) -> bool:
        return self.merge(pair[0] + pair[1]) == list(pair)

    def _pieces(self, text: str) -> list[str]:
        """The pieces of a stretch of known characters."""
        end = len(text)
        starting: list[list[str]] = [[] for _ in range(end)]
        for last, (piece, length) in self.find.iter(text):
            starting[last - length + 1].append(piece)  # ends ascend, so the longest is last
        failed = bytearray((end >> 3) + 1)
        taken: list[str] = []
        choice: list[int] = []
        together = self.together
        at, nth = 0, len(starting[0]) - 1
        while at < end:
            while nth >= 0:
                piece = starting[at][nth]
                after = at + len(piece)
                if not failed[after >> 3] >> (after & 7) & 1 and (not taken or together[taken[-1], piece]):
                    break
                nth -= 1
            if nth >= 0:
                taken.append(piece)
                choice.append(nth)
                at = after
                nth = len(starting[at]) - 1 if at < end else -1
            else:
                if not taken:
                    raise ValueError(f"no encoding for {text!r}")
                failed[at >> 3] |= 1 << (at & 7)
                at -= len(taken.pop())
                nth = choice.pop() - 1
        return taken

    def _encode_stretch(self, stretch: str) -> list[int]:
        ids: list[int] = []
        for run in self.known.findall(stretch):
            if run[0] in self.letters:
                ids.extend(map(self.ids.__getitem__, self._pieces(run)))
            else:
                ids.extend(map(self.bytes_ids.__getitem__, run.encode()))
        return ids

    def _as_text(self, stretch: str) -> str:
        return " ".join(map(str, self._encode_stretch(stretch)))

    def encode_text(self, text: str | None) -> str:
        """Decimal ids joined by one space, the end id last."""
        if not text:
            return str(self.end)
        stretches = self.cut.findall(BLANK + text.replace(" ", BLANK))
        remembered = self.remembered
        parts = [remembered[s] if len(s) <= REMEMBERED_LENGTH else self._as_text(s) for s in stretches]
        parts.append(str(self.end))
        return " ".join(parts)

    def encode(self, text: str | None) -> list[int]:
        return list(map(int, self.encode_text(text).split(" ")))

    def decode_bytes(self, ids: list[int]) -> bytes:
        """UTF-8 of the text; only the blank that encoding put in front is taken away."""
        raw = b"".join(map(self.surface.__getitem__, ids))
        return raw[1:] if raw[:1] == b" " else raw

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def coder(path: str) -> PieceCoder:
    """The coder of a vocabulary file, one per worker process."""
    return PieceCoder(path)


def ids_column(path: str, text: Column) -> Column:
    """The ids of a text column, array<int>."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        pieces = coder(path)
        return pd.Series([pieces.encode(t) for t in texts], dtype=object)

    return ids(text)


def text_column(path: str, ids: Column) -> Column:
    """The text that an ids column stands for; null ids give an empty text."""

    @F.pandas_udf("string")
    def texts(series: pd.Series) -> pd.Series:
        pieces = coder(path)
        return pd.Series(["" if i is None else pieces.decode(i) for i in series], dtype=object)

    return texts(ids)


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """Per document: number of ids, SHA-256 of the ids and of the text decoded from them."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(texts: pd.Series) -> pd.DataFrame:
        pieces = coder(path)
        surface = pieces.surface_of_text.__getitem__
        rows = []
        for text in texts:
            written = pieces.encode_text(text)
            ids = written.split(" ")
            decoded = b"".join(map(surface, ids))
            decoded = decoded[1:] if decoded[:1] == b" " else decoded
            rows.append((len(ids), *(hashlib.sha256(x).hexdigest() for x in (written.encode(), decoded))))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("_digest"))
    return found.select("doc_id", "_digest.*")
