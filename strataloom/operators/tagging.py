"""Dictionary tags in texts, by one pass of an Aho-Corasick automaton over words.

The automaton of the terms is broadcast, with its size checked first, and a table
function that is joined laterally reads each text once, whatever the number and
the length of the terms.  More terms than that are joined to all runs of words.
"""

from __future__ import annotations

from collections import deque
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of terms whose automaton is broadcast (it takes about ten times that).
TERM_BYTES = 16 << 20


class Automaton:
    """Flat arrays: transitions as sorted keys of (state, word), and per state its
    depth in words, the state of its longest proper suffix, its term, and the next
    state on the way of suffixes that ends a term (0: none)."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.words = {w: i for i, w in enumerate(sorted({w for t in terms for w in t.split(" ")}))}
        children: list[dict[int, int]] = [{}]
        term, depth = [-1], [0]
        for n, t in enumerate(terms):
            state = 0
            for w in t.split(" "):
                word = self.words[w]
                if word not in children[state]:
                    children[state][word] = len(children)
                    children.append({})
                    term.append(-1)
                    depth.append(depth[state] + 1)
                state = children[state][word]
            term[state] = n
        self.term, self.depth = np.array(term), np.array(depth)
        self.suffix, self.ending = np.zeros(len(children), dtype=np.int64), np.zeros(len(children), dtype=np.int64)
        todo = deque(children[0].values())
        while todo:
            state = todo.popleft()
            self.ending[state] = self.suffix[state] if term[self.suffix[state]] >= 0 else self.ending[self.suffix[state]]
            for word, child in children[state].items():
                back = int(self.suffix[state])
                while back and word not in children[back]:
                    back = int(self.suffix[back])
                to = children[back].get(word, 0)
                self.suffix[child] = to if to != child else 0
                todo.append(child)
        pairs = sorted(((s << 32) | w, c) for s, own in enumerate(children) for w, c in own.items())
        self.keys, self.targets = np.array([k for k, _ in pairs], dtype=np.int64), np.array([c for _, c in pairs], dtype=np.int64)

    def open(self) -> "Automaton":
        """Lookups as dictionaries and lists, made once per worker."""
        self._next = dict(zip(self.keys.tolist(), self.targets.tolist()))
        self._lists = [a.tolist() for a in (self.term, self.depth, self.suffix, self.ending)]
        return self

    def find(self, text: str):
        """(position of the first word, term) of all matches in a text of words with one space between."""
        term, depth, suffix, ending = self._lists
        state, words, step = 0, self.words, self._next
        for i, w in enumerate(text.split(" ")):
            word = words.get(w)
            if word is None:
                state = 0
                continue
            while (to := step.get((state << 32) | word)) is None and state:
                state = suffix[state]
            state = to or 0
            end = state if term[state] >= 0 else ending[state]
            while end:
                yield i - depth[end] + 1, self.terms[term[end]]
                end = ending[end]


def longest(found: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """From left to right the longest match at the first word that is free."""
    out, free = [], 0
    for at, t in sorted(found, key=lambda x: (x[0], -x[1].count(" "))):
        if at >= free:
            out.append((at, t))
            free = at + t.count(" ") + 1
    return out


def _runs(base: DataFrame, key: str, terms: DataFrame) -> DataFrame:
    """(key, position, form) by joining all runs of words with the terms."""
    sizes = terms.select(F.size(F.split("form", " ")).alias("n")).distinct().collect()  # one row a length

    def runs_of(n: int) -> DataFrame:
        words = F.split("_text", " ")
        forms = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
        return base.where(F.size(words) >= n).select(key, F.posexplode(forms).alias("position", "form"))

    return reduce(lambda a, b: a.unionByName(b), [runs_of(r.n) for r in sizes]).join(terms.select("form").distinct(), "form", "left_semi")


def tag(df: DataFrame, key: str, text: str, terms: DataFrame, overlap: bool = True, term_bytes: int = TERM_BYTES) -> DataFrame:
    """(key, position, form, label): dictionary tags, with abbreviations spread.

    ``terms`` has ``form`` (words with one space between), ``label`` and
    ``expansion`` (null unless the form is an abbreviation); a form may have
    several rows.  Every place where the words of a form stand in a text is a
    tag, positions count words from 0; without ``overlap`` only the longest from
    left to right are.  If one form of an abbreviation pair occurs in a text, the
    other one gets its label there too.  Terms of up to ``term_bytes`` are an
    automaton; more are joined to all runs of words (``overlap`` only).  Null
    texts, and no terms, give no tags.
    """
    spark = df.sparkSession
    known = terms.where("form <> ''").select("form", "label", "expansion").distinct()
    base = df.select(F.col(key), F.trim(F.regexp_replace(F.col(text), r"\s+", " ")).alias("_text")).where("_text is not null")
    n, size = known.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("form")), F.lit(0))).first()
    if not n:
        return base.select(key, F.lit(0).alias("position"), F.lit("").alias("form"), F.lit("").alias("label")).limit(0)
    if size <= term_bytes:
        shipped = spark.sparkContext.broadcast(Automaton(sorted(r.form for r in known.select("form").distinct().collect())))

        class Tagger:
            def __init__(self):
                self.automaton = shipped.value.open()

            def eval(self, words: str):
                found = self.automaton.find(words)
                yield from found if overlap else longest(list(found))

        tagger = F.udtf(Tagger, returnType="position int, form string", useArrow=True)
        hits = base.lateralJoin(tagger(F.col("_text").outer())).select(key, "position", "form").join(F.broadcast(known), "form")
    elif overlap:
        hits = _runs(base, key, known).join(known, "form")
    else:
        raise ValueError(f"{size} bytes of terms are more than {term_bytes}")
    spread = hits.where("expansion is not null").groupBy(key, F.col("expansion").alias("form"), "label").agg(F.min("position").alias("position"))
    return hits.select(key, "position", "form", "label").unionByName(spread.select(key, "position", "form", "label")).distinct()
