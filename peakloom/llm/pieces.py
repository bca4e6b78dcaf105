"""SentencePiece encoding and decoding through a table of distinct marked words."""

from __future__ import annotations

import re
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from peakloom.llm.common import documents, map_batches

MARK = "▁"
#: A marked word: white-space markers (a space and the marker character are one to the model) and what follows them.
WORD = re.compile(f"[ {MARK}]+[^ {MARK}]*")
#: Stands for a line's end in front of a word that has no marker; texts that hold it take the general way.
LINE = "\ue000"
#: Distinct words a task remembers before it starts the table anew: a bound on memory, without effect on results.
TABLE_WORDS = 400_000


class WordTable:
    """The distinct words that a task has met, each segmented once: its ids, and their decimal list.

    Exact for a model whose pieces never hold a marker behind another character nor a line's end beside another, that
    adds one marker in front of a text and changes nothing else; any other model is refused. Merges then never reach
    over the border in front of a marker or around a line's end, so a text's ids are those of its words in order.
    """

    def __init__(self, path: str):
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        if any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in pieces):
            raise ValueError("a piece crosses a white-space marker or a line's end")
        probe = "  Ａ ﬁ  é "
        if m.encode("") != [] or m.decode(m.encode(probe)) != probe or "".join(m.encode("a  b ", out_type=str)) != f"{MARK}a{MARK}{MARK}b{MARK}":
            raise ValueError("the model rewrites texts before it segments them")
        self.lone = m.piece_to_id(MARK)
        if m.encode("\n")[0] != self.lone:
            raise ValueError("a line's end joins the marker in front of it")
        self.marked = np.array([p[0] == MARK for p in pieces])
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.listed: list[str] = []
        self.flat, self.start = np.zeros(1 << 20, np.int32), np.zeros(TABLE_WORDS + 1, np.int64)

    def keys(self, text: str) -> list[str]:
        """``text`` as keys of the table: a plain key has one marker in front that is not written, an empty one is that
        marker alone, ``LINE`` is a line's end with what follows up to the next marker, and a leading space says that
        the key's markers are written out (runs of them, and marker characters of the text)."""
        return [f" {w}" for w in WORD.findall(f" {text}".replace(MARK, " "))] if text else []

    def rows(self, words: list[str]) -> np.ndarray:
        """The table's row of each of the distinct ``words``; new ones are segmented first.

        New plain words go to the library many to a text: each has one marker, in front, so a piece that begins with the
        marker begins a word.
        """
        new = [w for w in words if w not in self.row]
        if len(self.row) + len(new) > TABLE_WORDS:
            self.clear()
            new = words
            if len(new) > TABLE_WORDS:
                self.start = np.zeros(len(new) + 1, np.int64)
        plain = [w for w in new if w and w[0] != " "]
        if plain:
            given = ["\n" + w[1:] if w[:1] == LINE else w for w in plain]
            groups = [" ".join(given[i : i + 128]) for i in range(0, len(given), 128)]
            ids = np.fromiter(chain.from_iterable(map(self.model.encode, groups)), np.int32)
            cut = np.flatnonzero(self.marked[ids])
            if len(cut) != len(plain):
                raise AssertionError("a word got more than one marker")
            skip = np.fromiter((w[:1] == LINE for w in plain), bool, len(plain))
            keep = np.ones(len(ids), bool)
            keep[cut[skip]] = False
            self._add(plain, ids[keep], np.diff(np.r_[cut, len(ids)]) - skip)
        spelt = [w for w in new if not w or w[0] == " "]
        if spelt:
            each = [self.model.encode(w[2:]) if w.strip(" ") or len(w) > 2 else [self.lone] for w in spelt]
            self._add(spelt, np.fromiter(chain.from_iterable(each), np.int32), np.array([len(x) for x in each]))
        return np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))

    def _add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        at = len(self.listed)
        ends = self.start[at] + np.cumsum(sizes)
        while ends[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.start[at] : ends[-1]] = ids
        self.start[at + 1 : at + 1 + len(words)] = ends
        strings, e = list(map(str, ids.tolist())), np.cumsum(sizes).tolist()
        self.listed += [",".join(strings[a:b]) for a, b in zip([0, *e], e, strict=False)]
        self.row.update(zip(words, range(at, at + len(words)), strict=True))

    def _joined(self, words: list[str], codes: np.ndarray, offsets: np.ndarray) -> tuple[list[list[int]], list[str]]:
        """Ids and decimal list of texts: ``codes`` are their words in order, ``offsets`` where each text begins."""
        rows = self.rows(words)
        listed = pa.array([self.listed[r] for r in rows.tolist()], pa.string()).take(pa.array(codes))
        strings = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), listed), ",").to_pylist()
        r = rows[codes]
        size = self.start[r + 1] - self.start[r]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[r] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)].tolist()
        cut = np.r_[0, ends][offsets].tolist()
        return [ids[a:b] for a, b in zip(cut, cut[1:], strict=False)], strings

    def segment(self, texts: pa.Array) -> tuple[list[list[int]], list[str]]:
        """For each text its ids and their decimal list, joined by commas; null is empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.or_(pc.match_substring_regex(texts, f"^ |^$|  |{MARK}|{LINE}"), False).to_numpy(zero_copy_only=False)
        ids: list = [None] * len(texts)
        listed: list = [None] * len(texts)

        def put(where: np.ndarray, found: tuple[list[list[int]], list[str]]) -> None:
            for i, x, y in zip(where.tolist(), *found, strict=True):
                ids[i], listed[i] = x, y

        if not odd.all():
            split = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(~odd)), pattern="\n", replacement=f" {LINE}"), pattern=" ")
            coded = split.flatten().dictionary_encode()
            put(np.flatnonzero(~odd), self._joined(coded.dictionary.to_pylist(), coded.indices.to_numpy(), split.offsets.to_numpy()))
        if odd.any():
            split = [self.keys(t) for t in texts.filter(pa.array(odd)).to_pylist()]
            code: dict[str, int] = {}
            codes = np.fromiter((code.setdefault(w, len(code)) for w in chain.from_iterable(split)), np.int64)
            put(np.flatnonzero(odd), self._joined(list(code), codes, np.cumsum([0, *map(len, split)])))
        return ids, listed


_tables: dict[str, WordTable] = {}


def word_table(path: str) -> WordTable:
    """One table for each model and worker process."""
    if path not in _tables:
        _tables[path] = WordTable(path)
    return _tables[path]


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``id_col``, ``ids`` (array<int>, if asked for), ``n_tokens``, ``ids_sha256``, ``decoded`` text's ``decoded_sha256``.

    Encodes without begin or end ids and without sampling; null texts are empty, with no ids; very long texts are encoded
    whole. ``model_path`` must be
    readable on every executor (an installed package's file is). Rows are independent, repeated rows give equal
    results, other columns are not read, and an empty table gives an empty result.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = word_table(model_path)
        ids, joined = table.segment(batch.column(1))
        n = [len(x) for x in ids]
        digest = [sha256(x.encode()).hexdigest() for x in joined]
        back = [sha256(x.encode()).hexdigest() for x in map(table.model.decode, ids)]
        cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())]
        names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            cols.append(pa.array(ids, pa.list_(pa.int32())))
            names.append("ids")
        return pa.record_batch(cols, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), step, f"{id_col} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir), piece_model(), with_ids=False)
