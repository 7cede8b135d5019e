"""Token counts from a tokenizer compiled to finite-state transducers.

Two deterministic machines stand in for the library. The first reads classes of characters and finds
the pieces that the split pattern makes. A text is cut into short lanes; a lane's state map tells
for every entering state where it leaves, and a parallel prefix scan composes the maps, so that
all lanes of a batch of texts are read in step. The second reads the symbols of a piece. Its state
holds every token that could still be cut differently, together with the number of tokens before it
relative to the piece's own count, so a transition knows by how much the count changes. Its
states and transitions are made when they are first met.

The second machine rests on a property of byte-pair encoding: tokens are the encoding of their text
if and only if each two neighbours are the encoding of theirs.
"""

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from beaconlake.llm.common import slices, text_bytes

#: Characters that are scanned at once, and characters of a lane.
AT_ONCE, LANE = 1 << 21, 64
#: Pieces whose counts and states whose transitions a worker remembers; then it starts anew.
REMEMBERED, STATES_KEPT = 1 << 19, 1 << 18

# Classes of characters. The letters are those that the pattern's contractions are made of.
SPACE, LETTER, NUMBER, OTHER, QUOTE, STMD, R, V, L, E = range(10)
# States: where the scan stands in the split pattern.
BETWEEN, IN_LETTERS, IN_OTHER, AFTER_QUOTE, AFTER_R, AFTER_V, AFTER_L, CONTRACTED = range(8)
STATES = 8
LETTERS = (LETTER, STMD, R, V, L, E)
#: Unicode's White_Space characters.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def character_classes() -> np.ndarray:
    classes = np.full(0x110000, OTHER, dtype=np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind in "LN":
            classes[code] = LETTER if kind == "L" else NUMBER
    classes[WHITE_SPACE] = SPACE
    for letters, kind in (("'", QUOTE), ("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E)):
        for letter in letters:
            classes[ord(letter)] = kind
    return classes


def split_machine() -> np.ndarray:
    """``next[class * STATES + state]`` for the pattern of contractions, letters, numbers, others."""
    table = np.empty((10, STATES), dtype=np.uint8)
    table[SPACE] = table[NUMBER] = BETWEEN
    table[OTHER] = IN_OTHER
    table[QUOTE] = AFTER_QUOTE
    table[QUOTE, [IN_OTHER, AFTER_QUOTE]] = IN_OTHER
    for letter in LETTERS:
        table[letter] = IN_LETTERS
    for letter, state in ((STMD, CONTRACTED), (R, AFTER_R), (V, AFTER_V), (L, AFTER_L)):
        table[letter, AFTER_QUOTE] = state
    table[E, [AFTER_R, AFTER_V]] = CONTRACTED
    table[L, AFTER_L] = CONTRACTED
    return table.ravel()


def scan(classes: np.ndarray, machine: np.ndarray) -> np.ndarray:
    """The state after each character, all lanes read in step from composed state maps."""
    lanes = -(-len(classes) // LANE)
    columns = np.zeros(lanes * LANE, dtype=np.intp)
    columns[: len(classes)] = classes
    columns = np.ascontiguousarray(columns.reshape(lanes, LANE).T) * STATES
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (lanes, 1))
    for column in columns:
        maps = machine[maps + column[:, None]]
    step = 1
    while step < lanes:  # after each round a map covers twice as many lanes
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), axis=1)
        step *= 2
    state = np.r_[np.uint8(BETWEEN), maps[:-1, BETWEEN]]
    states = np.empty((LANE, lanes), dtype=np.uint8)
    for i, column in enumerate(columns):
        states[i] = state = machine[column + state]
    return states.T.ravel()[: len(classes)]


def piece_spans(classes: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces start and end. The text must end with a space."""
    before = np.r_[np.uint8(BETWEEN), states[:-1]]
    letter = (classes == LETTER) | (classes >= STMD)
    undecided = (states >= AFTER_R) & (states <= AFTER_L)
    starts = letter & ((before == BETWEEN) | (before == IN_OTHER) | (before == CONTRACTED))
    starts |= letter & (before == AFTER_QUOTE) & (states == IN_LETTERS)
    starts |= classes == NUMBER
    starts |= ((classes == OTHER) | (classes == QUOTE)) & (before != IN_OTHER) & (before != AFTER_QUOTE)
    # A letter after a quote opens letters of its own if no contraction came of it.
    starts[:-1] |= undecided[:-1] & (states[1:] != CONTRACTED)
    events = np.flatnonzero(starts | (classes == SPACE))
    opening = starts[events]
    return events[opening], events[np.flatnonzero(opening) + 1]


class PieceMachine:
    """Counts the tokens of a piece; deterministic, with transitions made on first use.

    Symbols are bytes, and bytes plus 256 where they end a piece. A state is a tuple of
    ``(last token, node, lead)``: the node of the vocabulary's trie for what follows the token, and how
    many tokens more than the whole read so far the text up to the token has. The first entry is the
    one with nothing after its token.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list, end: str):
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spelled = {chr(b): b for b in plain}
        spelled |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}

        def symbols(token: str) -> tuple:
            ends = token.endswith(end)
            codes = [spelled[c] for c in (token[: -len(end)] if ends else token)]
            return (*codes[:-1], codes[-1] + 256 * ends)

        self.tokens = [symbols(t) for t in vocabulary]
        number = {t: i for i, t in enumerate(self.tokens)}
        self.base = {t[0]: i for i, t in enumerate(self.tokens) if len(t) == 1}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(merges):
            left, right = map(symbols, pair.split(" ") if isinstance(pair, str) else pair)
            self.merge.setdefault((number[left], number[right]), (rank, number[left + right]))
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for i, token in enumerate(self.tokens):
            node = 0
            for symbol in token:
                if symbol not in self.children[node]:
                    self.children[node][symbol] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = self.children[node][symbol]
            self.token_at[node] = i
        self.begin()

    def begin(self) -> None:
        start = ((-1, 0, 0),)
        self.states, self.known, self.moves = [start], {start: 0}, [{}]
        self.allowed: dict[tuple[int, int], bool] = {}

    def encode(self, symbols) -> list[int]:
        """Byte-pair encoding by its definition, for the compilation of neighbours."""
        ids = [self.base[s] for s in symbols]
        while len(ids) > 1:
            ranked = [(self.merge[p][0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.merge]
            if not ranked:
                break
            at = min(ranked)[1]
            ids[at : at + 2] = [self.merge[ids[at], ids[at + 1]][1]]
        return ids

    def neighbours(self, left: int, right: int) -> bool:
        """Whether the two tokens are the encoding of their text; without a left one, the token alone."""
        pair = left, right
        if pair not in self.allowed:
            kept = [t for t in pair if t >= 0]
            self.allowed[pair] = self.encode(sum((self.tokens[t] for t in kept), ())) == kept
        return self.allowed[pair]

    def move(self, state: int, symbol: int) -> tuple[int, int]:
        """Next state and change of the count; makes the transition."""
        whole, kept = None, []
        for last, node, lead in self.states[state]:
            after = self.children[node].get(symbol)
            if after is None:
                continue
            token = self.token_at[after]
            if whole is None and token >= 0 and self.neighbours(last, token):
                whole = (token, lead + 1)
            if self.children[after]:
                kept.append((last, after, lead))
        token, change = whole
        entries = ((token, 0, 0), *((last, node, lead - change) for last, node, lead in kept))
        if symbol >= 256:
            entries = self.states[0]
        target = self.known.get(entries)
        if target is None:
            target = self.known[entries] = len(self.states)
            self.states.append(entries)
            self.moves.append({})
        self.moves[state][symbol] = target, change
        return target, change

    def count(self, piece: bytes) -> int:
        state = total = 0
        moves = self.moves
        for symbol in (*piece[:-1], piece[-1] + 256):
            step = moves[state].get(symbol)
            state, change = step or self.move(state, symbol)
            total += change
        return total


class TokenCounter:
    """Counts the tokens of texts as the library does for a file of lower-cased word pieces."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        self.special = [t["content"] for t in content["added_tokens"] if t["special"]]
        vocabulary = {t: i for t, i in model["vocab"].items() if t not in self.special}
        self.pieces = PieceMachine(vocabulary, model["merges"], model["end_of_word_suffix"])
        self.classes, self.machine = character_classes(), split_machine()
        self.counts: dict[str, int] = {}

    def normal(self, text: str) -> str:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # one character at a time, so no final form

    def segments(self, text: str) -> tuple[list[str], int]:
        """The text between special strings, and how many of those there are."""
        parts, found = [text], 0
        for special in self.special:
            if special in text:
                parts = [p for part in parts for p in part.split(special)]
        if len(parts) > 1:
            found = len(parts) - 1
        return parts, found

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text. All are scanned together, separated by spaces."""
        if len(self.pieces.states) > STATES_KEPT:
            self.pieces.begin()
        totals = np.zeros(len(texts), dtype=np.int64)
        joined, owners, length = [], [], 0
        for i, text in enumerate(texts):
            parts, totals[i] = self.segments(text)
            for part in parts:
                part = self.normal(part)
                joined += [part, " "]
                length += len(part) + 1
                owners.append((length, i))
        if not owners:
            return totals
        whole = "".join(joined)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        classes = self.classes[codes]
        starts, ends = piece_spans(classes, scan(classes, self.machine))
        counts = self.counts
        found = np.empty(len(starts), dtype=np.int64)
        for k, (at, end) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            piece = whole[at:end]
            n = counts.get(piece)
            if n is None:
                if len(counts) >= REMEMBERED:
                    counts.clear()
                n = self.pieces.count(piece.encode("utf-8", "surrogatepass"))
                if len(piece) <= 64:
                    counts[piece] = n
            found[k] = n
        part_ends = np.array([o[0] for o in owners])
        np.add.at(totals, np.array([o[1] for o in owners])[np.searchsorted(part_ends, starts, "right")], found)
        return totals

    def count_long(self, text: str) -> int:
        """Tokens of one text, taken in parts that end at white space."""
        total, at = 0, 0
        while at < len(text):
            end = min(len(text), at + AT_ONCE)
            while end < len(text) and not (self.classes[ord(text[end])] == SPACE and text[end - 1] != "|"):
                end += 1
            total += int(self.count([text[at:end]])[0])
            at = end
        return total


_COUNTERS: dict[str, TokenCounter] = {}


def counter(name: str) -> TokenCounter:
    if name not in _COUNTERS:
        import public_tokenizers

        _COUNTERS[name] = TokenCounter(public_tokenizers.path(name))
    return _COUNTERS[name]


def _counted(name: str, limit: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(name)
        for frame in slices(frames, "text", AT_ONCE):
            texts = [t if isinstance(t, str) else "" for t in frame["text"]]
            if sum(map(len, texts)) > 2 * AT_ONCE:
                tokens = [count.count_long(t) for t in texts]
            else:
                tokens = count.count(texts)
            sizes = [len(text_bytes(t)) for t in texts]
            out = frame.drop(columns="text").assign(n_bytes=sizes, n_tokens=tokens)
            yield out.assign(over_limit=out["n_tokens"] > limit).astype({"n_bytes": "int64", "n_tokens": "int64"})

    return run


def token_counts(
    documents: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = 2048
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``documents``.

    Whole texts are counted as the library counts them without added tokens: special strings inside
    a text count one each. A missing text counts as an empty one. Repeated rows each get a
    row; other columns are ignored; an empty table gives no rows.
    """
    rows = documents.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(
        _counted(tokenizer, limit), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )
