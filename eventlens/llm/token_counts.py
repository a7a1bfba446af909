"""Token counts under a unigram vocabulary, by dynamic programming over a trie."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import keyed

#: Nodes of a task's trie, pre-tokens whose count it remembers, their bytes, and bytes of text
#: looked at before these may be begun anew, which costs time and changes no count.
TRIE_NODES, KNOWN_TOKENS, KNOWN_BYTES, CHUNK_BYTES = 800_000, 500_000, 1 << 26, 1 << 20
#: Letters of a pre-token from which on its prefixes have no nodes: others hardly share them.
LONG_TOKEN = 4096
#: Begins a pre-token, as in the vocabulary.
MARK = "▁"
#: A byte of a character without a piece costs as much as the worst piece and this.
UNKNOWN = 10.0


class PieceTrie:
    """Trie of pre-tokens whose nodes hold the best segmentation of what leads to them.

    A node has the forward score of its prefix (the best sum of piece scores) and the
    number of pieces of that segmentation.  Pre-tokens with a common prefix share its
    nodes, so these are computed once; a terminal's count is stored with its pre-token.
    Of equal scores the one with fewer pieces counts.  Of a long pre-token only the
    scores that the longest piece reaches back to are held, in the same order of sums.
    """

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN
        #: Lengths of the pieces that end with the same two letters, and of single letters.
        lengths: dict[str, set[int]] = {}
        for piece in pieces:
            lengths.setdefault(piece[-2:], set()).add(len(piece))
        self.lengths = {
            end: sorted(n | lengths.get(end[-1:], set())) for end, n in lengths.items()
        }
        self.longest = max(map(len, pieces), default=1)
        self.forget()
        self.clear()

    def forget(self) -> None:
        self.counts: dict[bytes, int] = {}
        self.known_bytes = 0

    def clear(self) -> None:
        # Children by node and letter in one number.
        self.children: dict[int, int] = {}
        self.score, self.count = [0.0], [0]

    def __len__(self) -> int:
        return len(self.score)

    def insert(self, token: bytes) -> int:
        """The number of pieces of a pre-token."""
        text = MARK + token.decode("utf-8", "replace")
        n = self._rolling(text) if len(text) > LONG_TOKEN else self._walk(text)
        self.counts[token] = n
        self.known_bytes += len(token)
        return n

    def _walk(self, text: str) -> int:
        if len(self) > TRIE_NODES:
            self.clear()
        children = self.children
        node, score, count, i = 0, [0.0], [0], 0
        for letter in text:
            i += 1
            key = node << 21 | ord(letter)
            node = children.get(key)
            if node is None:
                node = children[key] = len(self.score)
                s, c = self._forward(text, i, score, count)
                self.score.append(s)
                self.count.append(c)
            score.append(self.score[node])
            count.append(self.count[node])
        return count[-1]

    def _rolling(self, text: str) -> int:
        score, count, low = [0.0], [0], 0
        for begin in range(0, len(text), LONG_TOKEN):
            back = max(0, begin - self.longest - 1)
            score, count, low = score[back - low :], count[back - low :], back
            part = text[low : begin + LONG_TOKEN]
            for i in range(begin - low + 1, len(part) + 1):
                s, c = self._forward(part, i, score, count)
                score.append(s)
                count.append(c)
        return count[-1]

    def _forward(
        self, text: str, i: int, score: list[float], count: list[int]
    ) -> tuple[float, int]:
        """Best score and count of ``text[:i]`` from those of its shorter prefixes."""
        pieces = self.pieces
        best, fewest = None, 0
        lengths = self.lengths.get(text[i - 2 : i] if i > 1 else text[:1])
        if lengths is None:
            lengths = self.lengths.get(text[i - 1], ())
        for n in lengths:
            if n > i:
                break
            s = pieces.get(text[i - n : i])
            if s is not None:
                s += score[i - n]
                if best is None or s > best or (s == best and count[i - n] + 1 < fewest):
                    best, fewest = s, count[i - n] + 1
        n = len(text[i - 1].encode("utf-8", "replace"))
        s = score[i - 1] + n * self.unknown
        if best is None or s > best:
            best, fewest = s, count[i - 1] + n
        return best, fewest


def unigram_pieces(model_file: str) -> dict[str, float]:
    """Pieces and scores of a SentencePiece model, without control and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return {
        sp.id_to_piece(i): float(sp.get_score(i))
        for i in range(sp.get_piece_size())
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))
    }


_SPACE = re.compile(rb"[ \t-\r]")


def _parts(text: pa.Buffer) -> Iterator[tuple[list[bytes], int]]:
    """Pre-tokens of a text and the bytes they stand in, a bounded part at a time.

    A part ends at white space, so only a single pre-token can make it longer.
    """
    data, at = memoryview(text), 0
    while at < len(data):
        space = _SPACE.search(data, at + CHUNK_BYTES)
        end = space.start() if space else len(data)
        yield bytes(data[at:end]).split(), end - at
        at = end


def count_tokens(
    docs: DataFrame, pieces: dict[str, float], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, text_key, n_pretokens, n_tokens)`` of each row, from its whole text.

    Pre-tokens are runs of bytes that are not ASCII white space, each with the mark of a
    word's beginning.  A pre-token is cut into the pieces with the largest sum of
    scores; characters without a piece are cut into their UTF-8 bytes.  The pieces (a
    vocabulary of fixed size) go to every task; texts are not shuffled.  Null and
    empty texts have no tokens; very long texts are counted part by part, and a long
    pre-token is no branch of the trie.  Repeated rows get equal counts; other columns are not
    read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PieceTrie(pieces)
        for batch in batches:
            words, tokens = [0] * len(batch), [0] * len(batch)
            chunk, size = [], 0
            for row, text in enumerate(batch.column("text")):
                for part, n in _parts(text.as_buffer()) if text.is_valid else ():
                    chunk.append((row, part))
                    size += n
                    if size >= CHUNK_BYTES:
                        add(trie, chunk, words, tokens)
                        chunk, size = [], 0
            add(trie, chunk, words, tokens)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("text_key"),
                    pa.array(words, pa.int64()), pa.array(tokens, pa.int64()),
                ],
                names=["doc_id", "text_key", "n_pretokens", "n_tokens"],
            )

    def add(trie: PieceTrie, chunk: list, words: list[int], tokens: list[int]) -> None:
        if len(trie.counts) > KNOWN_TOKENS or trie.known_bytes > KNOWN_BYTES:
            trie.forget()
        for token in set().union(*(part for _, part in chunk)) - trie.counts.keys():
            trie.insert(token)
        for row, part in chunk:
            words[row] += len(part)
            tokens[row] += sum(map(trie.counts.__getitem__, part))

    return keyed(docs, id_col, text_col).mapInArrow(
        count, "doc_id long, text_key long, n_pretokens long, n_tokens long"
    )
