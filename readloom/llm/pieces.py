"""Operator 10: encoding and decoding for merge-type sentencepiece vocabularies.

The merges come from an own agenda over adjacent symbol pairs, ordered by the score of the piece they make and then
from the left. Short segments run through it together: one step takes the first pair of the agenda in every segment
of an Arrow batch at once (numpy); long segments have a heap of their own. A text is first cut wherever no piece of
the vocabulary holds the two characters around the cut, because no merge can cross such a place; segments are kept
with their result, so that a repeated word is merged once. In every Arrow batch, new words of two or more characters
that begin with the space mark are encoded by the sentencepiece library as well, and a difference ends the job. Other
words, the joining of words into a text and decoded texts are not compared there.
"""

from __future__ import annotations

import gc
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tokenizer_file

SPACE = "▁"
#: Segments of more symbols than this have an agenda of their own.
LONG = 48
#: Segments kept by a worker; beyond that it starts anew.
KEEP = 500_000
NEVER = np.int64(1 << 40)
RESULT_SCHEMA = "doc_id long, n_tokens long, ids string, decoded string"


class MergeVocabulary:
    """The pieces of a model, and the pairs of symbols that merge.

    Symbols are numbers: the ids of pieces, then numbers for characters that only occur inside pieces, then -1 for
    all other characters, which never merge.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end_id = lib.eos_id()
        n = lib.vocab_size()
        pieces = [lib.id_to_piece(i) for i in range(n)]
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(pieces) if lib.is_byte(i)}
        self.silent = {i for i in range(n) if lib.is_control(i)}
        self.unknown = lib.unk_id()
        self.text_of = ["" if i in self.silent else " ⁇ " if i == self.unknown else p.replace(SPACE, " ") for i, p in enumerate(pieces)]
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        normal = {p: i for i, p in enumerate(pieces) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))}
        self.ids = dict(normal)
        for c in sorted({c for p in normal for c in p} - normal.keys()):
            self.ids[c] = n + len(self.ids) - len(normal)
        self.size, self.symbols = n, n + len(self.ids) - len(normal) + 1
        self.joins = {p[i : i + 2] for p in normal for i in range(len(p) - 1)}
        self.line_ends_alone = not any("\n" in j for j in self.joins)
        self.spaces_lead = not any(j[1] == SPACE and j[0] != SPACE for j in self.joins)
        keys, made = [], []
        for p, i in normal.items():
            for cut in range(1, len(p)):
                a, b = self.ids.get(p[:cut]), self.ids.get(p[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.symbols + b)
                    made.append(i)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.pair_keys, self.pair_made = np.array(keys, np.int64)[order], np.array(made, np.int64)[order]
        self.pairs = dict(zip(self.pair_keys.tolist(), self.pair_made.tolist(), strict=True))
        scores = np.array([lib.get_score(i) for i in range(n)])
        ranked = {s: r for r, s in enumerate(sorted(set(scores.tolist()), reverse=True))}
        self.symbol_of = np.full(0x110000, -1, np.int64)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.symbol_of[ord(p)] = i
        self.rank = np.array([ranked[s] for s in scores.tolist()], np.int64)

    # -- agenda ---------------------------------------------------------------------------------------------------

    def symbols_of(self, segment: str) -> list[int]:
        return [self.ids.get(c, -1) for c in segment]

    def merge_long(self, segment: str) -> list[tuple[int, int]]:
        """(symbol, number of characters) after all merges: a heap of (rank, place) over a linked list."""
        sym = self.symbols_of(segment)
        n = len(sym)
        left, right, width = list(range(-1, n - 1)), list(range(1, n + 1)), [1] * n
        agenda: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j < n and sym[i] >= 0 and sym[j] >= 0 and (m := self.pairs.get(sym[i] * self.symbols + sym[j])) is not None:
                heapq.heappush(agenda, (int(self.rank[m]), i, j, m, width[i] + width[j]))

        for i in range(n - 1):
            offer(i)
        while agenda:
            _, i, j, m, size = heapq.heappop(agenda)
            if not width[i] or not width[j] or right[i] != j or width[i] + width[j] != size:
                continue
            sym[i], width[i], width[j] = m, size, 0
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [(sym[i], width[i]) for i in range(n) if width[i]]

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of pairs; where nothing merges, ``NEVER``."""
        key = np.where((a >= 0) & (b >= 0), a * self.symbols + b, -1)
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        made = self.pair_made[at]
        return np.where(self.pair_keys[at] == key, self.rank[made], NEVER), made

    def merge_short(self, segments: list[str]) -> dict[str, list[int]]:
        """The ids of many short segments: in each step, every segment takes the first pair of its agenda.

        Segments of one length form a matrix of symbols beside one of the pairs' ranks; a step takes each row's
        smallest rank (the leftmost of equal ones) and renews the two pairs beside the merged symbol.
        """
        out: dict[str, list[int]] = {}
        by_length: dict[int, list[str]] = {}
        for s in segments:
            by_length.setdefault(len(s), []).append(s)
        for n, own in by_length.items():
            points = np.frombuffer("".join(own).encode("utf-32-le"), "<u4").reshape(len(own), n)
            sym = np.full((len(own), n + 1), -1, np.int64)
            sym[:, :n] = self.symbol_of[points]
            plain = (sym[:, :n] >= 0).all(axis=1)
            rank, _ = self.ranks_of(sym[:, :-1], sym[:, 1:])
            left, active = np.full(len(own), n), np.arange(len(own))
            while len(active):
                r = rank[active]
                best = r.argmin(axis=1)
                going = r[np.arange(len(active)), best] < NEVER
                active, best = active[going], best[going]
                if not len(active):
                    break
                s, r = sym[active], r[going]
                row = np.arange(len(active))
                _, made = self.ranks_of(s[row, best], s[row, best + 1])
                columns = np.arange(n)[None, :]
                beyond = columns > best[:, None]
                s[:, :n] = np.where(beyond, s[:, 1:], s[:, :n])
                s[row, best] = made
                r[:, : n - 1] = np.where(beyond[:, : n - 1], r[:, 1:], r[:, : n - 1])
                r[:, n - 1], s[:, n] = NEVER, -1
                r[row, best], _ = self.ranks_of(made, s[row, best + 1])
                inner = best > 0
                r[row[inner], best[inner] - 1], _ = self.ranks_of(s[row[inner], best[inner] - 1], made[inner])
                sym[active], rank[active] = s, r
                left[active] -= 1
            plain &= (sym < self.size).all(axis=1)
            for s, ids, k, good in zip(own, sym.tolist(), left.tolist(), plain.tolist(), strict=True):
                out[s] = ids[:k] if good else self.final_ids(s, self.merge_long(s))
        return out

    def final_ids(self, segment: str, merged: list[tuple[int, int]]) -> list[int]:
        """Piece ids; what is no piece falls back to its bytes, or to the unknown id."""
        out, place = [], 0
        for symbol, width in merged:
            if 0 <= symbol < self.size:
                out.append(symbol)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in segment[place : place + width].encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
            place += width
        return out

    def cuts(self, word: str) -> list[str]:
        """The word in segments that no merge can cross."""
        out, start = [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in self.joins:
                out.append(word[start:i])
                start = i
        out.append(word[start:])
        return out

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of words, which are texts in which spaces are already written as the space mark."""
        got = self.merge_short([w for w in words if 0 < len(w) <= LONG])
        for w in words:
            if len(w) > LONG:
                got[w] = [i for s in self.cuts(w) for i in self.final_ids(s, self.merge_long(s))]
        return got

    # -- texts ----------------------------------------------------------------------------------------------------

    def words_of(self, text: str) -> list[str]:
        """A text's words: the mark of a leading space, cut before each space mark that follows another character
        and around each line end, as far as no piece joins them."""
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        if self.line_ends_alone:
            out: list[str] = []
            for k, line in enumerate(marked.split("\n")):
                if k:
                    out.append("\n")
                if line:
                    out += self._line(line)
            return out
        return self._line(marked)

    def _line(self, line: str) -> list[str]:
        if not self.spaces_lead:
            return [line]
        first, *rest = line.split(SPACE)
        out = [first] if first else []
        run = ""
        for part in rest:
            run += SPACE
            if part:
                out.append(run + part)
                run = ""
        if run:
            out.append(run)
        return out

    def decode(self, ids: list[int], strip: bool = True) -> str:
        """The text of ids: byte pieces together as UTF-8; strip: the leading space of the first piece taken off."""
        out, held, first = [], bytearray(), strip
        for i in ids:
            if i in self.bytes_of:
                held.append(self.bytes_of[i])
                first = False
                continue
            if held:
                out.append(utf8_text(bytes(held)))
                held = bytearray()
            text = self.text_of[i]
            if first and i not in self.silent:
                text, first = text if i == self.unknown else text.removeprefix(" "), False
            out.append(text)
        if held:
            out.append(utf8_text(bytes(held)))
        return "".join(out)


def utf8_text(raw: bytes) -> str:
    """Bytes as UTF-8; each byte that starts no character becomes U+FFFD."""
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


class PieceCoder:
    """Words with their ids as text, their number and what they decode to, for one vocabulary and worker."""

    def __init__(self, path: str, verify: bool = True):
        self.vocabulary, self.verify, self.known = MergeVocabulary(path), verify, {}
        self.names = [str(i) for i in range(self.vocabulary.size)]

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if not new:
            return
        if len(self.known) + len(new) > KEEP:
            self.known.clear()
            new = list(words)
        v = self.vocabulary
        got = v.encode_words(new)
        if self.verify:
            # The library marks a leading space by itself, so it gets the words that begin with one, without it.
            led = [w for w in new if w[0] == SPACE and len(w) > 1]
            for w, ids in zip(led, v.library.encode([w[1:] for w in led], num_threads=1), strict=True):
                if ids != got[w]:
                    raise ValueError(f"the agenda and the library differ on {w!r}: {got[w]} and {ids}")
        names, text_of, bytes_of = self.names, v.text_of, v.bytes_of
        for w, ids in got.items():
            decoded = v.decode(ids, False) if any(i in bytes_of for i in ids) else "".join([text_of[i] for i in ids])
            self.known[w] = (" ".join([names[i] for i in ids]), len(ids), decoded)

    def batch(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids with the end id, the ids joined by spaces, the decoded text) of each text."""
        v = self.vocabulary
        words = [v.words_of(t) for t in texts]
        self.learn({w for x in words for w in x})
        end, known, out = str(v.end_id), self.known, []
        for x in words:
            got = [known[w] for w in x]
            decoded = "".join([g[2] for g in got])
            out.append((sum([g[1] for g in got]) + 1, " ".join([*[g[0] for g in got], end]), decoded[1:] if decoded[:1] == " " else decoded))
        return out


_coders: dict[tuple, PieceCoder] = {}


def encode_decode(docs: DataFrame, model_path: str, verify: bool = True, batch_chars: int = 1_000_000) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by one space, the end id last) and decoded of every row.

    Null text counts as empty and gives the end id alone; an empty table gives no rows; long texts are encoded whole;
    rows that repeat a doc_id each give a row; other columns are not read. Narrow: no shuffle, and a worker keeps at
    most ``KEEP`` words and one batch of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the words kept are many small objects without cycles
        try:
            yield from coded(batches)
        finally:
            gc.enable()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coders.get((model_path, verify))
        if coder is None:
            _coders.clear()
            coder = _coders[model_path, verify] = PieceCoder(model_path, verify)

        def done(ids: list, texts: list[str]) -> pa.RecordBatch:
            n, coded, decoded = zip(*coder.batch(texts), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

        ids: list = []
        texts: list[str] = []
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc_id)
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= batch_chars:
                    yield done(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield done(ids, texts)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, RESULT_SCHEMA)


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of all documents."""
    coded = encode_decode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
