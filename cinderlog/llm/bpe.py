"""BPE encoding and decoding by a tokenization automaton.

States stand for the token read last; all arcs with one label lead to one state. Merges are
compiled in their order, one gadget each, as in the published construction of BPE tokenization
automata: for a merge (u, v) giving w, the state after u loses its arc v, an arc w appears wherever
there is an arc u, and w leads to what the state after v is at that moment. A path through the
automaton is exactly a tokenization that the merges would give, and a word has one such path, so
every prefix of a word has exactly one last token. Encoding fills in that token place by place.

Two facts keep the table small. An arc w exists in a state just if its left part's arc did when w
was made, so arcs are found along the chain of left parts; and the state after w is the state after
its right part as it was then, so losses are found along the chain of right parts. Transitions are
looked up in a table filled on first use.

The normaliser (NFC, white space to one blank, lower case) and the split pattern are the ones the
tokenizer file states, so that the library only splits words; other files are refused. Defined results: null and empty
texts give no tokens. A column that clashes with a result is replaced. Special tokens inside a text are cut out first, as the file's library does.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

#: What a worker keeps at most: tokens of chunks between blanks and of words, and known arcs.
#: Together about 200 MB. A full table starts anew.
CHUNKS, WORDS, ARCS = 400_000, 500_000, 500_000
#: Below this all letters are old enough to be the same in every edition and normal form.
LATIN = "\u0250"
#: Letters that tell how far the labels reach that start with them.
PREFIX = 4

#: What the file must say for this module to apply.
NORMALIZERS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: What `encode` can add, with the types in Spark and Arrow.
RESULTS = {
    "t_n_tokens": ("long", pa.int64()),
    "t_ids": ("array<int>", pa.list_(pa.int32())),
    "t_ids_sha256": ("string", pa.string()),
    "t_decoded": ("string", pa.string()),
    "t_decoded_sha256": ("string", pa.string()),
}


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class Automaton:
    """Arcs and states of the tokenization automaton of a list of merges."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str):
        self.vocab, self.end = vocab, end
        self.left: dict[int, tuple[int, int]] = {}  # token: its left part, when it was made
        self.right: dict[int, tuple[int, int]] = {}  # token: its right part, when it was made
        self.lost: dict[tuple[int, int], int] = {}  # state, arc: when the state lost the arc
        symbols = {i for t, i in vocab.items() if len(t.removesuffix(end)) == 1}
        self.drawn = set(symbols)  # labels that have an arc anywhere
        for at, (u, v) in enumerate(merges):
            self._gadget(at, vocab[u], vocab[v], vocab[u + v])
        self.table: dict[int, bool] = {}
        # A token that no merge can give has no arc.
        self.arcs = {t: i for t, i in vocab.items() if i in self.drawn}
        # The longest label that starts with the same letters.
        self.reach: dict[str, int] = {}
        for label in self.arcs:
            label = label.removesuffix(end)
            key = label[:PREFIX]
            self.reach[key] = max(self.reach.get(key, 1), len(label))

    def _gadget(self, at: int, u: int, v: int, w: int) -> None:
        """Merge number `at`; without an arc v after u it has nothing to merge."""
        if u in self.drawn and v in self.drawn and self._follows(u, v):
            self.drawn.add(w)
            self.lost[u, v] = at
            # A token that several merges give keeps the arcs of the first.
            self.left.setdefault(w, (u, at))
            self.right.setdefault(w, (v, at))

    def follows(self, state: int, arc: int) -> bool:
        """Whether the state after a token has an arc with this label."""
        key = state << 32 | arc
        known = self.table.get(key)
        if known is None:
            known = self.table[key] = self._follows(state, arc)
        return known

    def _follows(self, state: int, arc: int) -> bool:
        never = 1 << 60
        source, copied = state, never
        while True:
            label, made = arc, never
            while True:
                at = self.lost.get((source, label))
                # Lost before the state was copied, and before a longer arc had been drawn.
                if at is not None and at < copied and at <= made:
                    return False
                if label not in self.left:
                    break
                label, made = self.left[label]
            if source not in self.right:
                return True
            source, copied = self.right[source]

    def encode(self, word: str) -> list[int]:
        """The tokens of one word, given in the byte alphabet.

        Reads the longest arc first. A place that no path leads on from is closed: as each
        prefix has one tokenization, it would be reached by the same token again.
        """
        n, arcs, end, reach = len(word), self.arcs, self.end, self.reach
        whole = arcs.get(word + end)
        if whole is not None:
            return [whole]
        table, follows = self.table, self.follows
        path: list[int] = []
        begins: list[int] = []
        closed: set[int] = set()
        at, upto, state = 0, n, -1
        while at < n:
            stop = at + reach.get(word[at : at + PREFIX], PREFIX - 1)
            if stop > upto:
                stop = upto
            while stop > at:
                token = arcs.get(word[at:stop] if stop < n else word[at:] + end)
                if token is not None and not (closed and stop in closed):
                    if state < 0:
                        break
                    fits = table.get(state << 32 | token)
                    if follows(state, token) if fits is None else fits:
                        break
                stop -= 1
            if stop > at:
                path.append(token)
                begins.append(at)
                at, upto, state = stop, n, token
            else:
                closed.add(at)
                upto = at - 1
                at = begins.pop()
                path.pop()
                state = path[-1] if path else -1
        return path

    @functools.cached_property
    def labels(self) -> dict[int, str]:
        return {i: t for t, i in self.vocab.items()}


class Codec:
    """Encodes and decodes whole texts as the tokenizer file says."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if (
            spec["normalizer"]["normalizers"] != NORMALIZERS
            or split["pattern"]["Regex"] != SPLIT
            or spec["decoder"] is not None
            or model["byte_fallback"]
            or model["ignore_merges"]
        ):
            raise ValueError(f"{path} asks for other steps than this codec has")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"])
        self.labels = self.automaton.labels | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("|".join(map(regex.escape, self.special)))
        self.words = regex.compile(SPLIT)
        self.letters = byte_alphabet()
        library = Tokenizer.from_file(path)
        self.normalize = library.normalizer.normalize_str
        self.split = library.pre_tokenizer.pre_tokenize_str
        self.cache: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def spell(self, word: str) -> str:
        """A word in the byte alphabet."""
        if word.isascii() and word.isprintable():
            return word
        return "".join([self.letters[b] for b in word.encode()])

    def _word(self, word: str) -> bytes:
        if len(self.known) >= WORDS:
            self.known.clear()
        if len(self.automaton.table) >= ARCS:
            self.automaton.table.clear()
        found = self.known[word] = np.array(self.automaton.encode(word), "<u4").tobytes()
        return found

    def _chunk(self, chunk: str) -> bytes:
        """The ids of a text without blanks, which no token spans."""
        if chunk.isascii() and chunk.isalpha():
            words = [chunk.lower()]
        elif chunk.isascii() and chunk[:-1].isalpha() and chunk[-1] in ".,!?;:":
            words = [chunk[:-1].lower(), chunk[-1]]
        elif chunk and max(chunk) < LATIN:
            words = [self.spell(w) for w in self.words.findall(chunk.lower())]
        else:  # classes and case of letters as in the library's edition of Unicode
            words = [w for w, _ in self.split(self.normalize(chunk))]
        if len(self.cache) >= CHUNKS:
            self.cache.clear()
        known, word = self.known, self._word
        found = self.cache[chunk] = b"".join([known.get(w) or word(w) for w in words])
        return found

    def _plain(self, text: str) -> bytes:
        # These two are the blanks worth cutting at; others are dealt with in the chunks.
        cache, chunk = self.cache, self._chunk
        return b"".join(
            [
                chunk(c) if (found := cache.get(c)) is None else found
                for c in text.replace("\n", " ").split(" ")
            ]
        )

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        if "<|" not in text:
            return self._plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self._plain(text[at : m.start()]), self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs; the file has no decoder, so they are joined by blanks."""
        labels = self.labels
        return " ".join([labels[i] for i in np.frombuffer(ids, "<u4").tolist()])


@functools.lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(
    df: DataFrame,
    path: str,
    text: str = "text",
    results: tuple[str, ...] = tuple(RESULTS),
    keep_text: bool = True,
) -> DataFrame:
    """df with the wanted RESULTS. Whole texts, no shuffle; the other columns ride along."""
    at = df.columns.index(text)
    kept = [
        i for i, c in enumerate(df.columns) if c not in results and (keep_text or c != text)
    ]
    names = [*(df.columns[i] for i in kept), *results]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                part = whole.slice(start, 64)
                ids = [own.encode(t or "") for t in part[at].to_pylist()]
                made = {
                    "t_n_tokens": lambda: [len(i) // 4 for i in ids],
                    "t_ids": lambda: [np.frombuffer(i, "<i4") for i in ids],
                    "t_ids_sha256": lambda: [hashlib.sha256(i).hexdigest() for i in ids],
                    "t_decoded": lambda: texts,
                    "t_decoded_sha256": lambda: [
                        hashlib.sha256(t.encode()).hexdigest() for t in texts
                    ],
                }
                texts = [own.decode(i) for i in ids]
                new = [pa.array(made[r](), RESULTS[r][1]) for r in results]
                yield pa.RecordBatch.from_arrays(
                    [*(part[i] for i in kept), *new], names=names
                )

    fields = ["`{}` {}".format(*df.dtypes[i]) for i in kept]
    return df.mapInArrow(run, ", ".join([*fields, *(f"{r} {RESULTS[r][0]}" for r in results)]))
