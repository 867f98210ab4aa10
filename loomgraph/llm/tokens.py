"""Token ids of whole texts with the tokenizers library, chunk by chunk.

Most chunks of a text (a word with the space before it) have been seen before. A chunk is
encoded once per worker and looked up after that; texts are cut only where the tokenizer
itself always cuts, so the ids are those of the whole text.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from contextlib import contextmanager
from itertools import chain, repeat

import numpy as np

from loomgraph.llm.shared import process_cache, trimmed

#: Chunks that a worker remembers before it starts afresh, where the caller sets no other bound.
REMEMBERED = 1_000_000
WAITING = 300_000
SHORT = 9
#: Letters and signs that no normal form joins, and the pieces both kinds of tokenizer cut them into.
LETTERS, SIGNS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?#*$%&|"
RUN = f"(?:[{LETTERS}]++|[{SIGNS}]++)"  # possessive: a run is never taken in parts, so no match takes long
PLAIN = re.compile(f" ?[{LETTERS}]++")
PIECE = re.compile(f" ?{RUN}|\\n")
MIXED = re.compile(f" ?{RUN}(?:\\n?{RUN})*+")
#: Among chunks behind a zero each, a space with white space or nothing behind it.
ODD = re.compile("\0 (?:[\\s\0]|$)")
#: Words that one call encodes together.
TOGETHER = 50
#: Chunks that the tokenizer is given at a time: what it returns for one takes up to a kilobyte.
AT_ONCE = 10_000
#: Chunks whose ids are laid out at a time.
BLOCK = 1 << 18


class ChunkEncoder:
    """Encodes texts by chunks.

    ``keeps_space`` says that the tokenizer puts a space with the word after it and keeps
    all white space; else it drops white space.
    """

    def __init__(self, tokenizer_json: str, keeps_space: bool, remembered: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.marks = re.compile("|".join(map(re.escape, marks)), re.IGNORECASE) if marks else None
        self.heads = sorted({c for m in marks for c in (m[0].lower(), m[0].upper())})
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 2**16 else "<u4")
        self.keeps_space, self.remembered = keeps_space, remembered
        # chunks by number; the ids of number n are the bytes of raw between ends n and n + 1
        self.known, self.raw, self.ends = {"": 0}, bytearray(), array("q", [0, 0])
        self.safe = re.compile(r"(?<=\S)(?= \S)")
        # which ids begin a word with its space, or else end a word
        vocab = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.edge[[i for t, i in vocab.items() if (t.startswith("\u0120") if keeps_space else t.endswith("</w>"))]] = True

    def chunks(self, text: str) -> list[str]:
        if not self.keeps_space:
            return text.split(" ")
        body = text.rstrip()
        if "\0" in text or "  " in body or " \n" in body or not body:
            return self.safe.split(text)
        parts = body.replace(" ", "\0 ").split("\0")
        parts[-1] += text[len(body) :]
        return parts

    @staticmethod
    def unclean(chunks: set[str]) -> set[str]:
        """The chunks before which the tokenizer does not always make a cut."""
        if not ODD.search("\0" + "\0".join(chunks)):
            return set()
        return {c for c in chunks if c[:1] == " " and (len(c) == 1 or c[1].isspace())}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. One that holds the string of an added token, which the tokenizer
        looks for before it cuts, is encoded as a whole."""
        marked = [self.marked(t) for t in texts]
        if any(marked):
            rest = iter(self.encode([t for t, m in zip(texts, marked, strict=True) if not m]))
            return [self.whole(t) if m else next(rest) for t, m in zip(texts, marked, strict=True)]
        with no_collection():
            return self.encode_plain(texts)

    def encode_plain(self, texts: list[str]) -> list[np.ndarray]:
        known, cut = self.known, [self.chunks(t) for t in texts]
        flat, codes, missing = self.numbered(cut)
        odd = self.unclean(missing) if self.keeps_space else None
        if odd:
            # white space after a space: cut such a text more carefully
            cut = [self.safe.split(t) if odd.intersection(p) else p for t, p in zip(texts, cut, strict=True)]
            flat, codes, missing = self.numbered(cut)
            odd = self.unclean(missing)
        most = self.remembered or REMEMBERED
        if len(known) + len(missing) > most:  # short chunks are the ones that come again
            del flat, codes, missing
            short = [c for c in known if 0 < len(c) <= SHORT]
            self.keep(short if 2 * len(short) < most else [])
            flat, codes, missing = self.numbered(cut)
        if missing:
            self.learn(missing)
            open_ = np.flatnonzero(codes < 0)
            codes[open_] = np.fromiter(map(known.__getitem__, map(flat.__getitem__, open_.tolist())), np.int64, len(open_))
        ids, ends = self.laid(codes)
        bounds = ends[np.cumsum([0, *map(len, cut)])].tolist()
        for chunk in odd or ():  # chunks that are right only where they stood are not remembered
            known.pop(chunk, None)
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def numbered(self, cut: list[list[str]]) -> tuple[list[str], np.ndarray, set[str]]:
        """The chunks of all texts in a row, the number of each or -1, and those without one."""
        flat = list(chain.from_iterable(cut))
        codes = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        return flat, codes, set(map(flat.__getitem__, np.flatnonzero(codes < 0).tolist()))

    def put(self, chunks, ids: np.ndarray, ends: np.ndarray) -> None:
        """Numbers new chunks, whose ids lie in a row and have these ends."""
        n, base = len(self.ends) - 1, len(self.raw)
        self.known.update(zip(chunks, range(n, n + len(ends)), strict=True))
        self.raw += ids.tobytes()
        self.ends.frombytes((base + ends.astype(np.int64) * self.dtype.itemsize).tobytes())

    def put_lists(self, chunks: list[str], lists: list[list[int]]) -> None:
        ids = np.fromiter(chain.from_iterable(lists), self.dtype)
        self.put(chunks, ids, np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists))))

    def put_joined(self, chunks, parts: list[list[str]]) -> None:
        """Numbers chunks whose ids are those of known ones in a row."""
        codes = np.fromiter(map(self.known.__getitem__, chain.from_iterable(parts)), np.int64)
        ids, ends = self.laid(codes)
        self.put(chunks, ids, ends[np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])

    def keep(self, chunks: list[str]) -> None:
        """Forgets all but these chunks, and empties the list: the texts are made anew once all are
        free, as a few old ones all over the memory would keep it from the system."""
        codes = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        (ids, ends), lengths = self.laid(codes), list(map(len, chunks))
        joined = "".join(chunks).encode("utf-32-le", "surrogatepass")
        chunks.clear()
        self.known.clear()
        self.known[""], self.raw, self.ends = 0, bytearray(), array("q", [0, 0])
        trimmed()
        cuts = np.cumsum([0, *lengths]) * 4
        self.put([joined[a:b].decode("utf-32-le", "surrogatepass") for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], ids, ends[1:])

    def laid(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered chunks in a row, and the places before and behind each."""
        data, known, size = np.frombuffer(self.raw, self.dtype), np.frombuffer(self.ends, np.int64), self.dtype.itemsize
        blocks, ends = [], np.zeros(len(codes) + 1, np.int64)
        for i in range(0, len(codes), BLOCK):
            part = codes[i : i + BLOCK]
            starts = known[part] // size
            lengths = known[part + 1] // size - starts
            to = np.concatenate([[0], np.cumsum(lengths)])
            ends[i + 1 : i + len(to)] = ends[i] + to[1:]
            blocks.append(data[np.repeat(starts - to[:-1], lengths) + np.arange(to[-1])])
        return np.concatenate(blocks) if blocks else np.zeros(0, self.dtype), ends

    def marked(self, text: str) -> bool:
        """Whether a text may hold the string of an added token; most lack even its first letter."""
        return any(h in text for h in self.heads) and self.marks.search(text) is not None

    def settle(self) -> None:
        """At the end of a task: a worker that waits for another holds short chunks alone."""
        if len(self.known) > WAITING:
            self.keep([c for c in self.known if 0 < len(c) <= SHORT][:WAITING])

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def learn(self, missing: set[str]) -> None:
        """Encodes chunks. One of letters and signs is cut into its pieces, often known or
        wanted too, and these are encoded instead; words go to the tokenizer together."""
        known, plain, mixed, rest = self.known, [], {}, []
        pieces = set()
        for chunk in missing:
            if PLAIN.fullmatch(chunk):
                (plain if (chunk[0] == " ") == self.keeps_space else rest).append(chunk)
            elif MIXED.fullmatch(chunk) and len(found := PIECE.findall(chunk)) > 1:
                mixed[chunk] = found
                pieces.update(found)
            else:
                rest.append(chunk)
        for piece in pieces.difference(missing).difference(known):
            (plain if (piece[0] == " ") == self.keeps_space and PLAIN.fullmatch(piece) else rest).append(piece)
        self.learn_words(plain)
        for i in range(0, len(rest), AT_ONCE):
            some = rest[i : i + AT_ONCE]
            self.put_lists(some, [x.ids for x in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)])
        self.put_joined(mixed, list(mixed.values()))

    def learn_words(self, words: list[str]) -> None:
        """Encodes words side by side and cuts their ids where a word begins or ends. Where the
        cuts are not as many as the words, each word is encoded alone."""
        for i in range(0, len(words), AT_ONCE):
            self.learn_groups([words[j : min(j + TOGETHER, i + AT_ONCE)] for j in range(i, min(i + AT_ONCE, len(words)), TOGETHER)])

    def learn_groups(self, groups: list[list[str]]) -> None:
        joined = [("" if self.keeps_space else " ").join(g) for g in groups]
        for group, got in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(got.ids, self.dtype)
            edges = np.flatnonzero(self.edge[ids])
            if len(edges) != len(group):
                self.put_lists(group, [self.whole(word).tolist() for word in group])
                continue
            ends = np.append(edges[1:], len(ids)) if self.keeps_space else edges + 1
            self.put(group, ids[: ends[-1]], ends)


@contextmanager
def no_collection():
    """Keeps the collector of cycles from walking the chunks again and again; there are no cycles in them."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def encoder(tokenizer_json: str, keeps_space: bool, remembered: int | None = None) -> ChunkEncoder:
    """The encoder of this worker process."""
    kept = process_cache("encoders")
    key = (hash(tokenizer_json), keeps_space)
    if key not in kept:
        kept[key] = ChunkEncoder(tokenizer_json, keeps_space, remembered)
    return kept[key]


def slices(batch, max_chars: int = 1_000_000):
    """The rows of an Arrow batch of (id, text, ...) as lists of bounded text size; the batch
    is turned into Python's texts a few rows at a time."""
    rows, size = [], 0
    for at in range(0, batch.num_rows, 256):
        for row in zip(*[c.to_pylist() for c in batch.slice(at, 256).columns], strict=True):
            rows.append(row)
            size += len(row[1] or "")
            if size >= max_chars:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows
