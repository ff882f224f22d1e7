"""Token counts of whole texts by a linear longest-match automaton.

The vocabulary is a trie over bytes. Every node has a failure link and the number of pieces that are
popped on the way along it, so one pass over a word's bytes gives the number of greedy word pieces;
no piece is built. A step either reads a byte or follows a link, and links are paid for by bytes read
before: the work is linear in the text.
"""

from __future__ import annotations

import json

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from scholium.llm.common import byte_words, id_and_text, map_arrow

#: Distinct words whose counts a task remembers before it starts again; bounds its memory, not its results.
REMEMBERED_WORDS = 200_000


def byte_alphabet() -> dict[str, int]:
    """The byte behind each printable character of a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def read_vocabulary(path: str) -> list[bytes]:
    """All pieces of a byte-level vocabulary file that are made of text bytes.

    A piece that starts a word begins with a space byte, as such vocabularies have it.
    """
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    special = {t["content"] for t in content.get("added_tokens", [])}
    of = byte_alphabet()
    return sorted(bytes(of[c] for c in piece) for piece in content["model"]["vocab"] if piece not in special)


class LongestMatch:
    """Failure-link automaton over a vocabulary that holds every single byte.

    ``child[node << 8 | byte]`` is the trie; ``fail[node]`` the node left after the longest pieces at the
    front of the node's string are popped, and ``popped[node]`` how many were. The root fails to -1.
    """

    def __init__(self, pieces: list[bytes]):
        self.child: dict[int, int] = {}
        strings, is_piece = [b""], [False]
        for piece in pieces:
            node = 0
            for i, byte in enumerate(piece):
                key = node << 8 | byte
                node = self.child.get(key) or self.child.setdefault(key, len(strings))
                if node == len(strings):
                    strings.append(piece[: i + 1])
                    is_piece.append(False)
            is_piece[node] = node > 0
        missing = [b for b in range(256) if not (b in self.child and is_piece[self.child[b]])]
        if missing:
            raise ValueError(f"the vocabulary lacks single bytes, {missing[:5]} first")
        self.fail, self.popped = [-1] * len(strings), [0] * len(strings)
        parents = sorted((len(strings[node]), node, key >> 8, key & 255) for key, node in self.child.items())
        for _, node, parent, byte in parents:
            if is_piece[node]:
                self.fail[node], self.popped[node] = 0, 1
                continue
            at, count = self.fail[parent], self.popped[parent]
            while (at << 8 | byte) not in self.child:
                count += self.popped[at]
                at = self.fail[at]
            self.fail[node], self.popped[node] = self.child[at << 8 | byte], count

    def count(self, word: bytes) -> int:
        """Number of pieces of the greedy longest-match split of ``word``."""
        child, fail, popped = self.child, self.fail, self.popped
        node = total = 0
        for byte in word:
            nxt = child.get(node << 8 | byte)
            while nxt is None:
                total += popped[node]
                node = fail[node]
                nxt = child.get(node << 8 | byte)
            node = nxt
        while node:
            total += popped[node]
            node = fail[node]
        return total


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Words, UTF-8 bytes and greedy word pieces of every text.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored, repeated rows are counted each.
    A word is a run without ASCII white space, and is matched behind a space byte. Null, empty and
    white-space texts have no words and no pieces. Returns ``doc_id, n_words, n_bytes, n_tokens``.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    pieces = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))  # as large as the vocabulary

    def once():
        return LongestMatch(pieces.value), {}

    def count(batch: pa.RecordBatch, state) -> pa.RecordBatch:
        machine, known = state
        n_words, n_bytes, n_tokens = [], [], []
        for text in batch.column(1).to_pylist():
            words = byte_words(text)
            if len(known) > REMEMBERED_WORDS:
                known.clear()
            total = 0
            for word in words:
                n = known.get(word)
                if n is None:
                    n = machine.count(b" " + word)
                    if len(word) < 64:
                        known[word] = n
                total += n
            n_words.append(len(words))
            n_bytes.append(len(text.encode("utf-8", "surrogatepass")) if text else 0)
            n_tokens.append(total)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_bytes, n_tokens))],
            names=["doc_id", "n_words", "n_bytes", "n_tokens"],
        )

    return map_arrow(id_and_text(docs), count, "doc_id long, n_words long, n_bytes long, n_tokens long", once)
