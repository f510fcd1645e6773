"""Quality rules: base statistics of each document and a CRF that labels its lines as content or boilerplate.

Lines are the parts between line feeds; words are runs of characters other than space and 0x09-0x0D.  Each line with a
word has flags (length, symbols, capitals, repeated words, cue words, ...); Viterbi decoding of a linear-chain CRF,
fitted to the small labelled table below, labels them.  A document is kept if its base rules pass and at least
``CONTENT_SHARE`` of its words stand in lines labelled content.

Edge cases.  A null or blank text has no words: its statistics are 0, and it fails the base rules.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .bytescan import Texts, grams, mix, prefix, span_hashes
from .crf import Crf

CONTENT_SHARE = 0.5
CONTENT, BOILERPLATE = 0, 1
#: Words of small letters that stand in licence lines, notices and menus.
CUES = "licensed license licence copyright rights reserved terms privacy cookie cookies subscribe newsletter login sign-in signup menu home contact sitemap disclaimer advertisement sponsored"
FLAGS = ("short", "long", "sentence_end", "symbols", "separators", "capitals", "repeats", "copy", "cue", "shouting", "digits", "address", "first", "last")
N_FLAGS = len(FLAGS)
_SYMBOLS = np.array([chr(i) in "#*$%&|<>" for i in range(256)])
_UPPER = np.array([65 <= i <= 90 for i in range(256)])
_LOWER = np.array([97 <= i <= 122 for i in range(256)])
_DIGIT = np.array([48 <= i <= 57 for i in range(256)])
_SHOUT = np.array([chr(i) == "!" for i in range(256)])
_AT = np.array([chr(i) in "@/" for i in range(256)])
_END = np.array([chr(i) in ".!?" for i in range(256)])
_QUOTES = np.array([chr(i) in "\"')" for i in range(256)])


@lru_cache(1)
def _cues() -> np.ndarray:
    out = []
    for w in CUES.split():
        data = np.frombuffer(w.encode(), np.uint8)
        out.append(span_hashes(data, np.array([0]), np.array([len(data)]))[0])
    return np.array(out, np.uint64)


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether an equal one came before, and whether an equal one is anywhere else."""
    code, distinct = pd.factorize(keys)
    first = np.empty(len(distinct), np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    return first[code] != np.arange(len(code)), np.bincount(code, minlength=len(distinct))[code] > 1


class Statistics:
    """Base statistics of a slice of texts, and its lines that hold a word."""

    def __init__(self, scan: Texts):
        data, n = scan.data, len(scan)
        starts, ends, docs = scan.words()
        hashes = scan.hashes(starts, ends)
        points = prefix((data & 0xC0) != 0x80)
        by = lambda values, owner=docs: np.bincount(owner, weights=values, minlength=n).astype(np.int64)
        self.n_words = np.bincount(docs, minlength=n).astype(np.int64)
        self.word_chars = by(points[ends] - points[starts])
        symbols = prefix(_SYMBOLS[data])
        self.n_symbols = symbols[scan.offsets[1:]] - symbols[scan.offsets[:-1]]
        # words in windows of three words that occur twice in the text
        windows, places = grams(hashes, docs, 3)
        twice = places[_repeated(mix(windows ^ mix(docs[places].astype(np.uint64))))[1]]
        covered = np.zeros(len(starts), bool)
        for k in range(3):
            covered[twice + k] = True
        self.n_repeat_words = by(covered)
        # lines with a word
        a, b, owner = scan.lines()
        first, last = np.searchsorted(starts, a), np.searchsorted(starts, b)
        full = last > first
        a, b, owner, first, last = a[full], b[full], owner[full], first[full], last[full]
        key = span_hashes(data, a, b)
        copies = _repeated(mix(key ^ mix(owner.astype(np.uint64))))[0] if len(a) else np.zeros(0, bool)
        self.n_dup_lines = by(copies, owner)
        self.line_docs, self.line_words = owner, last - first
        self.line_codes = self._codes(scan, starts, ends, hashes, a, b, owner, first, last, copies)

    @staticmethod
    def _codes(scan, starts, ends, hashes, a, b, owner, first, last, copies) -> np.ndarray:
        data = scan.data
        if not len(a):
            return np.zeros(0, np.int64)

        def count(chars):
            total = prefix(chars[data])
            return total[b] - total[a]

        words = last - first
        upper, lower = count(_UPPER), count(_LOWER)
        tail = ends[last - 1] - 1
        for _ in range(2):
            tail = np.where(_QUOTES[data[tail]] & (tail > a), tail - 1, tail)
        line_of = np.repeat(np.arange(len(a)), words)
        inside = np.zeros(len(starts), bool)
        inside[np.repeat(first - np.cumsum(words) + words, words) + np.arange(int(words.sum()))] = True
        again = _repeated(mix(hashes[inside] ^ mix(line_of.astype(np.uint64))))[0]
        repeats = np.bincount(line_of, weights=again, minlength=len(a))
        lowered = scan.lowered()
        cue = prefix(np.isin(lowered.hashes(starts, ends), _cues()))
        lone = prefix((ends - starts == 1) & _SYMBOLS[data[starts]])
        size = np.maximum(b - a, 1)
        flags = [
            words < 4,
            words >= 12,
            _END[data[tail]],
            count(_SYMBOLS) * 12 > size,
            (lone[last] - lone[first]) * 4 >= words,
            upper > lower,
            (words >= 8) & (repeats * 2 > words),
            copies,
            cue[last] - cue[first] > 0,
            count(_SHOUT) * 2 >= words,
            count(_DIGIT) * 3 > size,
            count(_AT) * 6 >= np.maximum(words, 6),
            np.diff(owner, prepend=-1) > 0,
            np.diff(owner, append=owner[-1] + 1) > 0,
        ]
        out = np.zeros(len(a), np.int64)
        for i, f in enumerate(flags):
            out |= np.asarray(f).astype(np.int64) << i
        return out


#: The labelled table: documents whose lines begin with c (content) or b (boilerplate).
LABELLED = """
c The river rose in the night and the people of the lower town carried what they could to the church on the hill.
c By morning the water stood in the market square, and boats were tied to the columns of the old hall.
c Nobody was hurt.
b Licensed under the terms of the open license, version two.

b Home | News | Contact | Login
c The committee met on Tuesday to hear the report, which had been delayed for several weeks by the holidays.
c It was accepted after a short debate, and the chair thanked all who had worked on it.
b Copyright and all rights reserved.

c Most of the seeds were planted in the second week of the month, when the ground had become warm enough.
c They grew slowly at first.
c After the rain they doubled their height in a few days, and by the end of summer the field was full.
c A second crop followed.

b BUY NOW!! CHEAP!! BEST!! PRICES!! ONLY!! TODAY!! CALL!! US!! FREE!! OFFER!! NOW!!
b WIN!! BIG!! WIN!! BIG!! CLICK!! HERE!! FAST!! MONEY!! EASY!! CASH!! NOW!!

b GREAT!! DEALS!! ARE!! HERE!! SAVE!! SAVE!! SAVE!! ON!! ALL!! ITEMS!! TODAY!!
c The shop stands at the corner of the street.
b CALL!! US!! AND!! ASK!! FOR!! MORE!! OF!! THE!! SAME!! NOW!!

b shoes | hats | coats | belts | bags | socks | gloves | scarves | shirts | ties
b red | green | blue | black | white | brown
b small | medium | large
c All of them can be ordered.

b name | price | stock | colour | size | weight | height | depth | width
c Two of these were sold.

b best*** shoes*** in### town&&& for%%% all*** of$$$ you*** and### yours&&& today%%% only***
b more*** words### with&&& marks%%% at$$$ the*** end### of&&& each*** and%%% every### one***
c The end.

b win*** the### big&&& prize%%% now$$$ and*** here### again&&& for%%% free***

b Great*** deals### on&&& every%%% kind$$$ of*** shoes### and&&& hats%%% that$$$ you*** could### want.***
b Only*** for### today&&& and%%% only$$$ for*** you### and&&& your%%% friends$$$ in*** town.###
b Call*** us.###
b Come*** and### see&&& them%%% all$$$ before*** they### are&&& gone%%% for$$$ good*** and### ever.%%%
b Nobody*** has### more&&& of%%% them$$$ than*** we### have&&& here%%% in$$$ our*** shop.&&&
c The end of the page.

b More*** of### the&&& same%%% again$$$ and*** again### in&&& one%%% long$$$ line*** that### ends.***
b And*** then### another&&& one%%% that$$$ goes*** on### and&&& on%%% and$$$ ends*** too.***
c Plain words close it.

b First | second | third | fourth | fifth | sixth | seventh | eighth | ninth | tenth.
b Red | green | blue | white | black | brown | pink | grey | gold | silver.
c Plain words close it too.

b LOUD!! WORDS!! FILL!! THIS!! LINE!! FROM!! THE!! FIRST!! TO!! THE!! LAST!! ONE.!!
c Plain words close this one too.

c A plain first line of some length that says what happened and where, and that ends as it should.
c Then a plain line * with a star.
c And at 5% a year it grew, said the banker & the clerk, which was more than anyone had hoped for in town.

b cheap cheap cheap cheap cheap cheap cheap cheap cheap cheap pills pills pills pills pills pills pills
b buy buy buy buy buy buy buy buy buy now now now now now now now now

c She had never seen the sea.
c When the train came out of the tunnel, it lay before her, grey and without an end, and she forgot her book.
c Hours later she still stood at the window of the small hotel, and the keys were cold in her hand.
b Subscribe to our newsletter

b Menu
b Home
b Sitemap
c The first engine of this kind was built in a shed behind the house, from parts that nobody wanted any more.
c It ran for nine minutes.
c The second one ran for a year, and with it began the company that still has its name.
b Privacy terms cookies

c Prices rose by a tenth, said the office, and wages by less than half of that.
c Who had saved was poorer, who had borrowed was not.

c The walls were thick and the windows small.
c In winter a fire burned in every room, in summer the doors stood open from early morning until late at night.
c Guests were rare.
c In winter a fire burned in every room, in summer the doors stood open from early morning until late at night.

c One long line without a full stop can be content too if it goes on and on with words as people write them
c and so can the next one that follows it in the same way and that is not marked by anything odd at all

b http://a.example/b/c http://d.example/e/f http://g.example/h/i
b 12 44 98 17 23 91 55 10 47 88 20 31 94
b 7 19 28 41 63 77 80 95 11

c He said no.
c She said yes, and so they went.
c They came to a bridge that had been closed for years, and crossed it.
""".strip()


def labelled_lines() -> list[tuple[list[int], list[int]]]:
    out = []
    for doc in LABELLED.split("\n\n"):
        rows = doc.split("\n")
        s = Statistics(Texts.of(pa.array(["\n".join(r[2:] for r in rows)], pa.large_string())))
        out.append((s.line_codes.tolist(), [CONTENT if r[0] == "c" else BOILERPLATE for r in rows]))
    return out


@lru_cache(1)
def model() -> Crf:
    """The fitted CRF; the same in every process, since the table is."""
    return Crf(N_FLAGS, 2).fit(labelled_lines())


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_words long, n_lines long, n_content_lines long"


def quality_rules(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", content_share: float = CONTENT_SHARE) -> DataFrame:
    """Statistics, base rules and verdict, one row a document; map-only."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    held = docs.sparkSession.sparkContext.broadcast(model())  # fitted once; its size is that of the flags

    def work(batch, texts):
        s = Statistics(Texts.of(texts))
        tags = held.value.decode(s.line_codes, s.line_docs)
        n = len(texts)
        content = np.bincount(s.line_docs, weights=s.line_words * (tags == CONTENT), minlength=n).astype(np.int64)
        lines = np.bincount(s.line_docs, minlength=n).astype(np.int64)
        content_lines = np.bincount(s.line_docs, weights=tags == CONTENT, minlength=n).astype(np.int64)
        failed = (s.n_words < 50) | (100 * s.n_repeat_words > 50 * s.n_words)
        kept = ~failed & (content >= content_share * s.n_words)
        columns = [s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, failed, kept, content, lines, content_lines]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c) for c in columns]], [f.split()[0] for f in SCHEMA.split(", ")])

    return store.map_slices(docs, "text", work, SCHEMA)
