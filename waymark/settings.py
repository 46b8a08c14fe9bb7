"""Parameters of the search operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SearchSettings:
    # Defaults that the results depend on.
    min_prefix: int = 3  # shortest word that may be searched as a prefix
    length_window: int = 2  # suggestions differ in length by at most this
    rank_delta: int = 2  # suggestions must be closer than this to the best rank
    max_hits: int = 10  # hits per query variant and per request
    suggestion_count: int = 6  # suggestions kept per word
    search_short_words: bool = True  # also search abbreviations in their own field
    freq_threshold: int = 30000  # a word above this frequency is "frequent"
    many_like: int = 5  # this many prefix matches count as "many"
    drop_ratio: float = 0.001  # rare suggestions are dropped below this share
    boost_shift: float = 0.2  # a suggestion's boost is its precision less this
    single_boost: float = 0.9  # boost of a lone suggestion
    star_boost: float = 0.9  # boost of a prefix term
    length_penalty: int = 4  # ranking points lost per word of length difference
    expansion_limit: int = 32  # index terms a prefix term may stand for
    dictionary_size: int = 200000  # words kept in the dictionary
    rows_per_file: int = 50000  # rows per exported file
    # Our own: tuning of the physical plan; no effect on results.
    probe_rows: int = 1000  # postings a tolerant query reads before it sets a bound
    rare_rows: int = 256  # a term with more documents than this points to classes of them
    rows_per_task: int = 2_000_000  # a join key with more rows than this is salted


DEFAULTS = SearchSettings()
