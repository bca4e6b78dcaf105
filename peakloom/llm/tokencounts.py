"""Token counts by prefix dynamic programming: the count of every prefix of a text is stored, so that truncation and budget
questions are answered by looking up, not by encoding again."""

from __future__ import annotations

import json
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.llm.common import documents, map_batches

#: Characters of prefix counts that a task remembers before it starts its table anew: a bound on memory, without effect on results.
TABLE_CHARS = 8_000_000
#: White space (Unicode's White_Space), as a class for either regular expression library.
_SPACE = r"\x09-\x0d\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WHITE = regex.sub(r"\\x\{(\w+)\}", lambda m: f"\\u{int(m[1], 16):04x}", _SPACE)
#: A chunk is white space with what follows up to the next white space; no token of the model reaches over its ends.
CHUNK = regex.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
LEADING = regex.compile(f"[{_WHITE}]*")
#: How a byte-level model cuts a chunk's part that is not white space (one space may stand in front).
WORD = regex.compile(rf"'(?:[stmd]|re|ve|ll)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+")
#: Those of its words that are several shorter ones when cut short, and what these begin with.
CONTRACTIONS = {"'re", "'ve", "'ll"}
LETTERS = {"r", "v", "l"}
#: Stands for the border of two chunks; texts that hold it take the general way.
BORDER = "\ue000"


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: itself if it is printable, else one from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PrefixTable:
    """A byte-level BPE model, and the prefix counts of the distinct chunks that a task has met.

    Let a prefix of a word end in token ``t`` and let ``s`` be the last token of the prefix in front of ``t``: that is the
    model's encoding exactly if no merge joins ``s`` and ``t`` before they are whole (``apart``), and exactly one token
    ending at a place has that property. So the last token of a prefix follows from those of shorter prefixes, and its
    count is theirs plus one.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or spec["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError("not a plain byte-level BPE model")
        added = spec["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or not t["content"] for t in added):
            raise ValueError("an added token changes what stands beside it")
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        letters, vocab = byte_letters(), model["vocab"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(merges)}
        self.made = {vocab[a + b]: (vocab[a], vocab[b], r) for r, (a, b) in enumerate(merges)}
        if len(self.made) != len(merges) or any(self.made[t][2] >= r for a, b, r in self.made.values() for t in (a, b) if t in self.made):
            raise ValueError("the merges do not make each token once, from earlier ones")
        self.spines: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        reached = {t for t in vocab.values() if t not in self.made}
        for t, (a, b, r) in self.made.items():
            if a in reached and b in reached and self.apart(a, b, r):
                reached.add(t)
        #: Every end of a token: the token if it is one that the model makes of its bytes, else -1.
        self.ending: dict[bytes, int] = {}
        for word, t in vocab.items():
            data = bytes(letters[c] for c in word)
            for i in range(1, len(data)):
                self.ending.setdefault(data[i:], -1)
            if t in reached:
                self.ending[data] = t
            else:
                self.ending.setdefault(data, -1)
        if any(self.ending.get(bytes([b]), -1) < 0 for b in range(256)):
            raise ValueError("a byte has no token")
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.words: dict[str, bytes | list[int]] = {}
        self.flat, self.start = np.zeros(1 << 20, np.int32), np.zeros(1 << 16, np.int64)

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stand at one end of ``token`` while it is made, each with the rank of the merge that takes it up."""
        key = token, side
        if key not in self.spines:
            out, until = [], float("inf")
            while token in self.made:
                out.append((token, until))
                until, token = self.made[token][2], self.made[token][side]
            self.spines[key] = [*out, (token, until)]
        return self.spines[key]

    def apart(self, a: int, b: int, until: float = float("inf")) -> bool:
        """Whether ``a`` and ``b`` side by side stay so (up to merge ``until``). Of equal merges the one on the left goes first."""
        for left, left_until in self._spine(a, 1):
            for right, right_until in self._spine(b, 0):
                r = self.rank.get((left, right))
                if r is not None and r < min(left_until, until) and r <= right_until:
                    return False
        return True

    def learn(self, words: set[str]) -> None:
        """Tokens of each prefix of each word, by characters, kept in ``words``. In order of their bytes words follow each
        other that begin alike, and the prefixes that a word shares with the one before it are not counted again."""
        ending, pairs, before = self.ending, self.pairs, b""
        last, count = [-1], [0]
        for data, word in sorted((w.encode(), w) for w in words if w not in self.words):
            n, i = len(data), 0
            for x, y in zip(data, before, strict=False):
                if x != y:
                    break
                i += 1
            del last[i + 1 :], count[i + 1 :]
            for i in range(i + 1, n + 1):
                j, ends = i - 1, []
                while j >= 0 and (t := ending.get(data[j:i])) is not None:
                    if t >= 0:
                        ends.append((j, t))
                    j -= 1
                for j, t in reversed(ends):
                    if j == 0:
                        break
                    pair = last[j], t
                    ok = pairs.get(pair)
                    if ok is None:
                        ok = pairs[pair] = self.apart(*pair)
                    if ok:
                        break
                else:
                    raise AssertionError("no token ends here")
                last.append(t)
                count.append(count[j] + 1)
            before = data
            found = count[1:] if n == len(word) else [count[i] for i in np.cumsum([len(c.encode()) for c in word]).tolist()]
            self.words[word] = bytes(found) if n < 256 else found

    @staticmethod
    def cut(text: str) -> tuple[str, str, list[str]]:
        """A chunk's leading white space, the last of that if it is a word of its own before other characters, and the words
        behind (the first with a space in front, if there is one)."""
        space = LEADING.match(text).end()
        if not space or space == len(text):
            return text[:space], "", [] if space else WORD.findall(text)
        last = text[space - 1]
        return (text[:space], "", WORD.findall(text, space - 1)) if last == " " else (text[:space], last, WORD.findall(text, space))

    def chunk(self, space: str, last: str, words: list[str]) -> list[int]:
        """Tokens of each prefix of a chunk, by characters, from the first on."""
        known, out, base, at = self.words, [], 0, 0
        if space:
            out = [*known[space]]  # at the end of a prefix all its white space is one word
            base, at = out[-2] if len(out) > 1 else 0, len(out) - 1
            if last:
                base, at = base + known[last][-1], len(out)
        for word in words:
            found = known[word]
            if word in CONTRACTIONS:  # cut short it is none
                found = [found[0], found[0] + known[word[1]][0], found[2]]
            out += [base + n for n in found[len(out) - at :]]
            base, at = base + found[-1], at + len(word)
        return out

    def rows(self, chunks: list[str]) -> np.ndarray:
        """The table's row of each chunk; new ones are counted first."""
        new = [c for c in dict.fromkeys(chunks) if c not in self.row]
        if new and self.start[len(self.row)] > TABLE_CHARS:
            self.clear()
            new = list(dict.fromkeys(chunks))
        if new:
            cuts = [self.cut(c) for c in new]
            self.learn(LETTERS.union(*([x, y, *z] if y else [x, *z] if x else z for x, y, z in cuts)))
            at, found = len(self.row), [self.chunk(*c) for c in cuts]
            ends = self.start[at] + np.cumsum([len(x) for x in found])
            while ends[-1] > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while at + len(new) >= len(self.start):
                self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.flat[self.start[at] : ends[-1]] = np.fromiter(chain.from_iterable(found), np.int32)
            self.start[at + 1 : at + 1 + len(new)] = ends
            self.row.update(zip(new, range(at, at + len(new)), strict=True))
        return np.fromiter(map(self.row.__getitem__, chunks), np.int64, len(chunks))

    def _joined(self, rows: np.ndarray, offsets: np.ndarray, limit: int, counts: bool) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of texts, whose chunks are ``rows`` from each of ``offsets`` on: tokens, characters within ``limit``, prefix counts."""
        size = self.start[rows + 1] - self.start[rows]
        ends, chars = np.r_[0, np.cumsum(self.flat[self.start[rows + 1] - 1], dtype=np.int64)], np.r_[0, np.cumsum(size)]
        n = np.diff(ends[offsets])
        fit = np.diff(chars[offsets])
        for i in np.flatnonzero(n > limit).tolist():
            a, b = offsets[i], offsets[i + 1]
            # Every prefix that ends in a chunk has at least the tokens before that chunk and one more.
            k = a + int(np.searchsorted(ends[a:b] - ends[a], limit)) - 1
            inside = np.flatnonzero(self.flat[self.start[rows[k]] : self.start[rows[k] + 1]] <= limit - (ends[k] - ends[a])) if k >= a else np.zeros(0, int)
            fit[i] = (chars[k] - chars[a] + (inside[-1] + 1 if len(inside) else 0)) if k >= a else 0
        if not counts:
            return n, fit, []
        flat = self.flat[np.repeat(self.start[rows] - chars[:-1], size) + np.arange(chars[-1])] + np.repeat(ends[:-1], size)
        cut = chars[offsets]
        return n, fit, [(flat[a:b] - ends[o]).astype(np.int32) for (a, b), o in zip(pairwise(cut.tolist()), offsets.tolist(), strict=False)]

    def _general(self, text: str, limit: int, counts: bool) -> tuple[int, int, np.ndarray]:
        """One text of any kind: between added tokens, and the beginnings of those as the ordinary text that they are."""
        parts, base, at = [], 0, 0
        for m in [*(self.special.finditer(text) if self.special else ()), None]:
            end = m.start() if m else len(text)
            whole = text[at : m.end() - 1] if m else text[at:]
            chunks = CHUNK.findall(whole)
            _, _, (found,) = self._joined(self.rows(chunks), np.array([0, len(chunks)]), limit, True)
            parts.append(found + base)
            if m:
                base += (int(found[end - at - 1]) if end > at else 0) + 1
                parts.append(np.array([base], np.int32))
                at = m.end()
        found = np.concatenate(parts).astype(np.int32)
        within = np.flatnonzero(found <= limit)
        return int(found[-1]) if len(found) else 0, int(within[-1]) + 1 if len(within) else 0, found if counts else found[:0]

    def count(self, texts: pa.Array, limit: int, counts: bool) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """For each text its tokens, the characters of its longest prefix of at most ``limit`` tokens, and, if asked for, the
        tokens of each of its prefixes; null is empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring(texts, BORDER).to_numpy(zero_copy_only=False) | (pc.binary_length(texts).to_numpy() == 0)
        if self.special:
            odd |= pc.match_substring_regex(texts, self.special.pattern).to_numpy(zero_copy_only=False)
        n, fit, each = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [np.zeros(0, np.int32)] * len(texts)
        plain = np.flatnonzero(~odd)
        if len(plain):
            marked = pc.replace_substring_regex(texts.take(pa.array(plain)), pattern=f"([^{_SPACE}])([{_SPACE}])", replacement=f"\\1{BORDER}\\2")
            split = pc.split_pattern(marked, pattern=BORDER)
            coded = split.flatten().dictionary_encode()
            rows = self.rows(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
            n[plain], fit[plain], found = self._joined(rows, split.offsets.to_numpy(), limit, counts)
            for i, x in zip(plain.tolist(), found, strict=False):
                each[i] = x
        for i in np.flatnonzero(odd).tolist():
            n[i], fit[i], each[i] = self._general(texts[i].as_py(), limit, counts)
        return n, fit, each


_tables: dict[str, PrefixTable] = {}


def prefix_table(path: str) -> PrefixTable:
    """One table for each model and worker process."""
    if path not in _tables:
        _tables[path] = PrefixTable(path)
    return _tables[path]


def count_prefixes(docs: DataFrame, model_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", with_counts: bool = True) -> DataFrame:
    """``id_col``, ``n_bytes`` (UTF-8), ``n_tokens``, ``fit_chars`` (characters of the longest prefix of at most ``limit``
    tokens) and, if asked for, ``prefix_tokens``: the tokens of the prefix of one, two, ... characters.

    Counts are those of the tokenizers library without begin, end or added tokens; an added token's text is that token, as
    is the library's default. ``model_path`` must be readable on every executor (an installed package's file is). Null and
    empty texts have no tokens and an empty array; very long texts are counted whole; rows are independent, repeated rows
    give equal results, other columns are not read, and an empty table gives an empty result. A longer prefix can have
    fewer tokens than a shorter one; the longest within the limit is meant.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1)
        n, fit, each = prefix_table(model_path).count(texts, limit, with_counts)
        size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
        cols, names = [batch.column(0), size, pa.array(n, pa.int64()), pa.array(fit, pa.int64())], [id_col, "n_bytes", "n_tokens", "fit_chars"]
        if with_counts:
            offsets = pa.array(np.cumsum([0, *map(len, each)]), pa.int32())
            cols.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int32), *each]), pa.int32())))
            names.append("prefix_tokens")
        return pa.record_batch(cols, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), step, f"{id_col} {kind}, n_bytes bigint, n_tokens bigint, fit_chars bigint" + ", prefix_tokens array<int>" * with_counts)


def tokens_of_first(chars: Column | int, counts: str = "prefix_tokens") -> Column:
    """Tokens of the prefix of so many characters, from the stored counts; of all of a shorter text."""
    n = F.least(F.lit(chars) if isinstance(chars, int) else chars, F.size(counts))
    return F.when(n > 0, F.get(counts, n - 1)).otherwise(F.lit(0))


def chars_within(budget: Column | int, counts: str = "prefix_tokens") -> Column:
    """Characters of the longest prefix of at most ``budget`` tokens, from the stored counts."""
    most = F.lit(budget) if isinstance(budget, int) else budget
    return F.coalesce(F.array_max(F.transform(counts, lambda c, i: F.when(c <= most, i + 1))), F.lit(0))


def truncate(docs: DataFrame, counted: DataFrame, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each text cut to its longest prefix of at most ``budget`` tokens, by the stored counts (``id_col`` is
    unique in both; a document without counts keeps its text)."""
    cut = counted.select(F.col(id_col).alias("__id"), chars_within(budget).alias("__chars"))
    text = F.when(F.col("__chars").isNotNull(), F.substring(F.col(text_col), F.lit(1), F.col("__chars"))).otherwise(F.col(text_col))
    return docs.join(cut, F.col(id_col).eqNullSafe(F.col("__id")), "left").withColumn(text_col, text).select(*docs.columns)


def bpe_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = count_prefixes(documents(spark, sf_dir), bpe_model(), 512, with_counts=False)
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"), "fit_chars")
