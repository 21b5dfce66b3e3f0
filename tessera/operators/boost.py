"""Structure boosts of sections for a stated set of queries: one automaton of all their phrases runs over each text where it lies.

A phrase is 2 to 4 consecutive words of a query, and counts as often as the query has it: 25 points a word where a section's title holds it, else 5 where its
content does. A word of a query that is a section's code, or that a code goes on from after a full stop, counts 35. Only hits leave a section's task.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Queries of an automaton at most; more are taken in blocks.
QUERIES = 10_000
TITLE, CONTENT, CODE = 25, 5, 35


def cleaned(text: Column) -> Column:
    """Lower case, anything but words and . , - _ to spaces, white space collapsed."""
    c = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[^\w\s.,_-]", " ")
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def words(clean: Column, stopwords: tuple[str, ...]) -> Column:
    return F.filter(F.regexp_extract_all(clean, F.lit(r"(?U)\w+"), F.lit(0)), lambda w: (F.length(w) > 1) & ~w.isin(*stopwords))


class Phrases:
    """All phrases and codes of some queries; made from plain rows, so that a worker builds its automaton itself."""

    def __init__(self, queries: list[tuple[int, list[str], list[str]]]):
        self.queries = queries
        self.automaton = None

    def __getstate__(self):
        return {"queries": self.queries, "automaton": None}

    def build(self) -> None:
        import ahocorasick

        self.of: list[list[tuple[int, int]]] = []
        phrases: dict[str, dict[int, int]] = defaultdict(dict)
        self.codes: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for query, parts, tokens in self.queries:
            for n in (2, 3, 4):
                for phrase, times in Counter(" ".join(parts[i : i + n]) for i in range(len(parts) - n + 1)).items():
                    phrases[phrase][query] = n * times
            for token, times in Counter(tokens).items():
                self.codes[token].append((query, times))
        self.automaton = ahocorasick.Automaton()
        for phrase, at in phrases.items():
            self.automaton.add_word(phrase, len(self.of))
            self.of.append(list(at.items()))
        if phrases:
            self.automaton.make_automaton()

    def found(self, text: str) -> set[int]:
        return {k for _, k in self.automaton.iter(text)} if self.of and text else set()

    def points(self, title: str, content: str, code: str) -> dict[int, int]:
        if self.automaton is None:
            self.build()
        out: dict[int, int] = defaultdict(int)
        in_title = self.found(title)
        for k in in_title:
            for query, n in self.of[k]:
                out[query] += TITLE * n
        for k in self.found(content) - in_title:
            for query, n in self.of[k]:
                out[query] += CONTENT * n
        parts = code.split(".") if code else []
        for i in range(1, len(parts) + 1):
            for query, times in self.codes.get(".".join(parts[:i]), ()):
                out[query] += CODE * times
        return out


def boosted(queries: DataFrame, sections: DataFrame, stopwords: tuple[str, ...]) -> DataFrame:
    """(query_id, document_id, section_id, boost) of queries (query_id, text) and sections (document_id, section_id, section_code, title, content), where it is above 0. Null texts are empty."""
    clean = cleaned(F.col("text"))
    stated = [(r[0], [w for w in r[1].split(" ") if w], r[2]) for r in queries.select("query_id", clean, words(clean, stopwords)).collect()]
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))).alias(c)
    s = sections.select("document_id", "section_id", low("section_code"), low("title"), low("content"))
    schema = "query_id long, document_id long, section_id string, boost long"
    out = None
    for at in range(0, max(len(stated), 1), QUERIES):
        sent = queries.sparkSession.sparkContext.broadcast(Phrases(stated[at : at + QUERIES]))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            phrases = sent.value
            for b in batches:
                rows = [(q, d, s, n) for d, s, code, title, content in b.itertuples(index=False) for q, n in phrases.points(title, content, code).items()]
                yield pd.DataFrame(rows, columns=["query_id", "document_id", "section_id", "boost"])

        part = s.mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    return out
