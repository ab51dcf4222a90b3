"""Token counts of a unigram vocabulary without the tokens.

An Aho-Corasick automaton lists every vocabulary entry that ends at a character; the best score and
the number of pieces of the best path are carried from character to character, and no path is kept.
The rules are those of the ``tokenizers`` library's unigram model: a higher score wins, of equal scores the path
whose last piece starts first; a character without an entry of its own may be unknown at the lowest score less 10;
unknown characters in a row are one piece, or their UTF-8 bytes where the vocabulary has all byte pieces.

Words: where all scores are integers and no entry goes on past a word's start mark, the best path of a
text is those of its words in a row, sums are exact, and a worker works out a word once.
A null or empty text has no tokens. Ids may be null or repeat: each row is counted by itself.
"""

from __future__ import annotations

import re
import sys

from pyspark.sql import DataFrame

from .common import map_slices, two

MARK = "▁"


class Counter:
    """``count(text) -> (pieces, score)`` for the vocabulary ``[(entry, score), ...]``; of equal entries the last counts."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True, keep: int = 300_000):
        import ahocorasick
        self.scores = dict(vocabulary)
        self.automaton = ahocorasick.Automaton()
        for entry, score in self.scores.items():
            if entry:
                self.automaton.add_word(entry, (len(entry), score))
        self.automaton.make_automaton()
        self.single = {e for e in self.scores if len(e) == 1}
        self.unknown = min(self.scores.values()) - 10.0
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in self.scores for b in range(256))
        inside = re.compile(f"[^{MARK}]{MARK}")
        self.by_word = MARK in self.single and all(
            float(s).is_integer() and not inside.search(e) for e, s in self.scores.items())
        self.words = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.keep, self.kept = keep, {}

    def best(self, text: str) -> tuple[int, float]:
        """Pieces and score of the best path of one text."""
        n, single, unknown = len(text), self.single, self.unknown
        score, start = [0.0] * (n + 1), [-1] * (n + 1)
        count, open_run = [0] * (n + 1), [False] * (n + 1)
        done = 0

        def close(e):
            """All entries that end at ``e`` have been seen: the character before it may still be unknown."""
            c = text[e - 1]
            if c not in single:
                cand = score[e - 1] + unknown
                if start[e] < 0 or cand > score[e]:
                    score[e], start[e], open_run[e] = cand, e - 1, True
                    count[e] = count[e - 1] + (len(c.encode("utf-8", "surrogatepass")) if self.bytes else not open_run[e - 1])

        for at, (length, value) in self.automaton.iter(text):
            while done < at:
                done += 1
                close(done)
            e, s = at + 1, at + 1 - length
            cand = score[s] + value
            if start[e] < 0 or cand > score[e] or cand == score[e] and s < start[e]:
                score[e], start[e], count[e], open_run[e] = cand, s, count[s] + 1, False
        while done < n:
            done += 1
            close(done)
        return count[n], score[n]

    def count(self, text: str) -> tuple[int, float]:
        if not self.by_word:
            return self.best(text)
        words = self.words.findall(text)
        if len(self.kept) > self.keep:
            self.kept = {}
        kept = self.kept
        for w in set(words):
            if w not in kept:
                kept[w] = self.best(w)
        got = [kept[w] for w in words]
        return sum(g[0] for g in got), sum(g[1] for g in got)


def sentencepiece_vocabulary(path: str) -> list[tuple[str, float]]:
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def marked(text: str | None) -> str:
    """A space becomes the word mark, and a text starts with one."""
    return MARK + text.replace(" ", MARK) if text else ""


def counter(path: str) -> Counter:
    kept = sys.__dict__.setdefault("_formloom_counters", {})
    if path not in kept:
        kept[path] = Counter(sentencepiece_vocabulary(path))
    return kept[path]


def token_counts(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and score (the best path's) of every row, by the vocabulary file at ``vocabulary``."""
    def fn(rows):
        one = counter(vocabulary)
        got = [one.count(marked(t)) for t in rows["text"]]
        return {"doc_id": rows["doc_id"], "n_tokens": [g[0] for g in got], "score": [float(g[1]) for g in got]}
    return map_slices(two(docs, id_col, text_col), "text", "doc_id long, n_tokens long, score double", fn)
