"""BPE encoding and decoding by speculation and verification.

A greedy longest match proposes tokens for each distinct word. A proposal is the
true result of merging exactly when every token reproduces itself and no merge
can cross any boundary between neighbours, so all neighbouring pairs of a batch
are tested at once in numpy by undoing merges from the latest to the earliest.
Only words with a failing token or pair are merged exactly: short ones side by side
in numpy, long ones by a queue of merges over linked symbols, so that a word of
a million letters takes seconds.

Vocabulary files are read on the driver and broadcast (tens of thousands of
entries, whatever the input). They are of the kind with end-of-word marks:
NFC, lower case, white space dropped.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "</w>"
NEVER = np.int64(1) << 40
#: Symbols of a word up to which words are merged side by side; longer ones one by one.
SHORT = 256
#: Words, and pieces of text between white space, that a worker remembers before it starts anew.
CACHE = 400_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: visible ones are their own, the others follow from 256 in order."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class WordBPE:
    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        n = max(self.vocab.values()) + 1
        self.symbols: list[str] = [""] * n
        for s, i in self.vocab.items():
            self.symbols[i] = s
        self.rank = np.full(n, -1, np.int64)
        self.left, self.right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(pairs):
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.merge.setdefault((x, y), (r, z))
            if self.rank[z] < 0:
                self.rank[z], self.left[z], self.right[z] = r, x, y
        keys = np.array([x * n + y for x, y in self.merge], np.int64)
        order = np.argsort(keys)
        self.n, self.keys = n, keys[order]
        self.key_made = np.array([z for _, z in self.merge.values()], np.int64)[order]
        self.key_rank = np.array([r for r, _ in self.merge.values()], np.int64)[order]
        self.final = {t[: -len(END)]: i for t, i in self.vocab.items() if t.endswith(END)}
        self.inner = {t: i for t, i in self.vocab.items() if not t.endswith(END)}
        # for the first three characters of a token: the lengths that tokens with them have, longest first
        lengths: dict[str, set[int]] = {}
        for t in self.inner:
            if len(t) > 2:
                lengths.setdefault(t[:3], set()).add(len(t))
        self.lengths = {k: sorted(v, reverse=True) for k, v in lengths.items()}
        self.longest = max(map(len, self.final), default=0)
        made = np.flatnonzero(self.rank >= 0)
        whole = np.ones(n, bool)
        whole[made] = self.compatible(self.left[made], self.right[made], self.rank[made])
        for i in made[np.argsort(self.rank[made])]:
            whole[i] = whole[i] and whole[self.left[i]] and whole[self.right[i]]
        self.whole = whole
        specials = sorted((t["content"], t["id"]) for t in spec.get("added_tokens", []))
        self.specials = dict(specials)
        for s, i in specials:
            self.symbols.extend([""] * (i + 1 - len(self.symbols)))
            self.symbols[i] = s
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if specials else None
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(split)
        self.visible = dict(enumerate(byte_symbols()))
        self.known: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def compatible(self, x: np.ndarray, y: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """For each pair of neighbours: does no merge across the boundary come before ``until``?

        The two pieces at the boundary are taken apart, the one made later first.
        A merge across fires if it comes before either piece is used up; of equal
        ranks the one further left comes first.
        """
        ok = np.ones(len(x), bool)
        todo = np.arange(len(x))
        x, y = x.copy(), y.copy()
        gone_x = np.full(len(x), NEVER) if until is None else until.copy()
        gone_y = gone_x.copy()
        if until is not None:
            gone_y -= 1  # the pair's own merge is the one that ends it
        while len(todo):
            m, _ = self.ranks(x, y)
            bad = (m < gone_x) & (m <= gone_y)
            ok[todo[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            undo_x = rx > ry
            gone_x, gone_y = np.where(undo_x, rx, gone_x), np.where(undo_x, gone_y, ry)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
            more = ~bad & (np.maximum(rx, ry) >= 0)
            todo, x, y, gone_x, gone_y = todo[more], x[more], y[more], gone_x[more], gone_y[more]
        return ok

    def greedy(self, word: str) -> list[int]:
        """The longest token at each place; one that ends the word comes before all others. Empty if no token fits."""
        out, i, n, inner, final, lengths, longest = [], 0, len(word), self.inner, self.final, self.lengths, self.longest
        while n - i > longest or (t := final.get(word[i:])) is None:
            for k in lengths.get(word[i : i + 3], ()):
                if i + k < n and (t := inner.get(word[i : i + k])) is not None:
                    break
            else:
                k = 2 if i + 2 < n and word[i : i + 2] in inner else 1
                if i + k >= n or (t := inner.get(word[i : i + k])) is None:
                    return []
            out.append(t)
            i += k
        out.append(t)
        return out

    def ranks(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of merging each pair; NEVER if there is no such merge."""
        at = np.minimum(np.searchsorted(self.keys, key := x * self.n + y), len(self.keys) - 1)
        there = self.keys[at] == key
        return np.where(there, self.key_rank[at], NEVER), self.key_made[at]

    def merged(self, words: list[str]) -> list[bytes]:
        """Exact merging of many words side by side: in each round the pair of least rank of each word, leftmost first."""
        base = [[self.vocab[c] for c in w[:-1]] + [self.vocab[w[-1] + END]] for w in words]
        sizes = np.fromiter(map(len, base), np.int64, len(base))
        ids = np.fromiter((i for b in base for i in b), np.int64, int(sizes.sum()))
        word = np.repeat(np.arange(len(words)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []

        def pair_ranks(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """For the pairs that begin at these places; a word's last symbol begins none."""
            nxt = np.minimum(at + 1, len(ids) - 1)
            r, z = self.ranks(ids[at], ids[nxt])
            return np.where((nxt > at) & (word[nxt] == word[at]), r, NEVER), z

        rank, made = pair_ranks(np.arange(len(ids)))
        while len(ids):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat(rank * (1 << 20) + (np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))), first)
            over = best >= NEVER * (1 << 20)
            at = (first + (best & ((1 << 20) - 1)))[~over]
            ids[at] = made[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ended = np.repeat(over, np.diff(np.append(first, len(ids))))
            done.append((word[ended], ids[ended]))
            keep &= ~ended
            touched = np.zeros(len(ids), bool)
            touched[at] = True
            before = at[at > 0] - 1
            touched[before[word[before] == word[before + 1]]] = True
            ids, word, rank, made, touched = ids[keep], word[keep], rank[keep], made[keep], touched[keep]
            if len(ids):
                again = np.flatnonzero(touched)
                rank[again], made[again] = pair_ranks(again)
        word, ids = np.concatenate([w for w, _ in done]), np.concatenate([i for _, i in done])
        order = np.argsort(word, kind="stable")
        packed, ends = ids[order].astype(np.int32).tobytes(), (4 * np.cumsum(np.bincount(word, minlength=len(words)))).tolist()
        return [packed[lo:hi] for lo, hi in zip([0, *ends], ends)]

    def queued(self, word: str) -> bytes:
        """Exact merging of one long word: the pair of least rank first, leftmost of equals, from a queue."""
        ids = [self.vocab[c] for c in word[:-1]] + [self.vocab[word[-1] + END]]
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        rank, _ = self.ranks(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64))
        at = np.flatnonzero(rank < NEVER)
        queue = ((rank[at] << 40) | at).tolist()
        heapq.heapify(queue)
        merge = self.merge
        while queue:
            top = heapq.heappop(queue)
            i = top & ((1 << 40) - 1)
            if ids[i] < 0 or (j := after[i]) < 0 or (found := merge.get((ids[i], ids[j]))) is None or found[0] != top >> 40:
                continue  # one of the two has been merged since
            ids[i], ids[j] = found[1], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (more := merge.get((ids[i], ids[k]))) is not None:
                    heapq.heappush(queue, more[0] << 40 | i)
            if (h := before[i]) >= 0 and (more := merge.get((ids[h], ids[i]))) is not None:
                heapq.heappush(queue, more[0] << 40 | h)
        return np.array([t for t in ids if t >= 0], np.int32).tobytes()

    def words(self, words: list[str]) -> None:
        """Learn the tokens of words that are not yet known."""
        if not words:
            return
        guess = [self.greedy(w) for w in words]
        sizes = np.array([len(g) for g in guess])
        flat = np.fromiter((t for g in guess for t in g), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        failed = sizes == 0
        failed[owner[~self.whole[flat]]] = True
        near = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(flat[near] * self.n + flat[near + 1], return_inverse=True)
        good = self.compatible(pairs // self.n, pairs % self.n)
        failed[owner[near[~good[back]]]] = True
        ends = (4 * np.cumsum(sizes)).tolist()
        packed, at = flat.astype(np.int32).tobytes(), 0
        for w, f, end in zip(words, failed.tolist(), ends):
            if not f:
                self.known[w] = packed[at:end]
            at = end
        rest = [w for w, f in zip(words, failed.tolist()) if f and len(w) <= SHORT]
        if rest:
            self.known.update(zip(rest, self.merged(rest)))
        self.known.update((w, self.queued(w)) for w, f in zip(words, failed.tolist()) if f and len(w) > SHORT)

    def pieces(self, text: str) -> list[str]:
        """The words of a text in byte symbols."""
        if text.isascii():
            text = text.lower()
            if text.isalpha():
                return [text]
        else:
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # letter by letter: no final sigma
            if text.isalpha():
                return [text.encode().decode("latin-1").translate(self.visible)]
        return [m.encode().decode("latin-1").translate(self.visible) for m in self.split.findall(text)]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit integers."""
        parts: list[list] = []
        for t in texts:
            if self.special and "<|" in t:
                mine, at = [], 0
                for m in self.special.finditer(t):
                    mine += [*self.pieces(t[at : m.start()]), self.specials[m[0]]]
                    at = m.end()
                parts.append([*mine, *self.pieces(t[at:])])
            else:
                parts.append(self.pieces(t))
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        self.words(list({p for mine in parts for p in mine if type(p) is str} - known.keys()))
        return [known[mine[0]] if len(mine) == 1 and type(mine[0]) is str else b"".join([known[p] if type(p) is str else array("i", [p]).tobytes() for p in mine]) for mine in parts]

    def decode(self, ids) -> str:
        """As the library without a decoder: the tokens, one space between."""
        return " ".join([self.symbols[i] for i in ids])


_models: dict[str, WordBPE] = {}


def bpe_documents(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """docs' columns doc_id and ``text_col`` to doc_id, ids array<int>, decoded string.

    Whole texts; a null text counts as empty: no ids, decoded ''. Very long texts and
    very long words take time in proportion (n log n in a word's letters). Repeated rows, ties, null ids: each row by itself.
    Other columns, whatever their names, are not read.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    name = hashlib.sha256(json.dumps(spec).encode()).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast(spec)
    schema = "doc_id long, ids array<int>, decoded string"
    odd = regex.compile("[\x1c-\x1f]")

    def run(batches):
        model = _models.get(name)
        if model is None:
            _models.clear()
            model = _models[name] = WordBPE(sent.value)
        symbols = pa.array(model.symbols, pa.string())
        ids_of = model.chunks  # kept from task to task
        for batch in batches:
            split = []
            for t in batch.column(1).to_pylist():
                t = t or ""
                # tokens never span white space; texts with specials or separators that Python alone calls white space stay whole
                split.append([t] if "<|" in t or odd.search(t) else t.split())
            if len(ids_of) > 2 * CACHE:
                ids_of.clear()
            new = list(set().union(*split) - ids_of.keys())
            for lo in range(0, len(new), 50_000):
                part = new[lo : lo + 50_000]
                ids_of.update(zip(part, model.encode_many(part)))
            blobs = [b"".join([ids_of[c] for c in chunks]) for chunks in split]
            ends = np.cumsum([0, *(len(b) // 4 for b in blobs)]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(blobs), np.int32))
            ids = pa.ListArray.from_arrays(pa.array(ends), flat)
            decoded = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), symbols.take(flat)), " ")
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), ids, decoded], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """doc_id, decoded of rows with an array of ids: the tokens, one space between; a null or empty array gives ''. Ids outside the vocabulary fail."""
    with open(vocabulary, encoding="utf-8") as f:
        symbols = WordBPE(json.load(f)).symbols
    sent = encoded.sparkSession.sparkContext.broadcast(symbols)

    def run(batches):
        table = pa.array(sent.value, pa.string())
        for batch in batches:
            ids = pc.fill_null(batch.column(1), pa.scalar([], pa.list_(pa.int32())))
            ends = pa.array(np.cumsum([0, *pc.list_value_length(ids).to_pylist()]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_join(pa.ListArray.from_arrays(ends, table.take(ids.flatten())), " ")], names=["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, decoded string")


def bpe_digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    out = bpe_documents(docs, vocabulary)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
