"""Benchmark decontamination by template canonicalisation.

Texts become word sequences in two forms.  Plain: every word in lower case.  Template:
numbers, the units after them, and names (capitals) are replaced by typed
placeholders, a run of one type by one; the words replaced are kept as slot values.
Windows of ``width`` words of the benchmark are hash-joined with all windows of all
documents.  When the benchmark's hashes are few (``filter_windows``) each task first drops
the windows that are not among them, so only likely matches are shuffled; otherwise all
windows are.  For template matches the slots are checked: within an occurrence of an item (matches
aligned by place in the document minus place in the item) a value must always stand for
one value; windows that disagree with the assignment do not count, and the best occurrence
is reported.  A document that holds at least ``share`` of an item's windows in
either form is contaminated by it: verbatim, or re-parameterised.

Template windows with fewer than ``literals`` words that are not placeholders say nothing and
are left out on both sides and of the item's number of windows; an item left without any takes
wider ones (``item_windows``).  A capital that opens a sentence is a word or a name: templates
are built and matched in both ways, the better share counts.

Defined cases: null or empty texts match nothing; an item shorter than ``width`` words is
one window of its length; an item of ``width`` template words or fewer
with fewer than ``literals`` (or its length) literal ones, and one without any, is found verbatim
only; every row of documents is judged by itself, whether its doc_id is null or repeated, and
so is every different (item_id, text); extra columns are ignored; empty tables give an empty
result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import arrow_map, char_tables, code_points, mix, prefix_sums, row_keys, span_hash, text_slices

# Units of measure that may follow a number.
UNITS = ("kg g mg t lb lbs oz km m cm mm mi mile miles ft feet inch inches yd l ml litre litres liter liters gal s sec "
         "second seconds ms min minute minutes h hr hrs hour hours day days week weeks month months year years percent "
         "dollar dollars euro euros cent cents usd eur gbp mph kmh hz khz mhz w kw v a j kj cal kcal pa bar degrees "
         "stunden minuten sekunden tage jahre heures minutes jours ans horas minutos segundos días años").split()
NUM, UNIT, NAME = 1, 2, 3
HOLDERS = mix(np.array([101, 202, 303, 404], np.uint64))
STOPS = np.zeros(0x110000, bool)
STOPS[[ord(c) for c in ".!?\n:;\"“”„«»"]] = True


def _code(words) -> np.ndarray:
    return np.array([int(span_hash(prefix_sums(np.array([ord(c) for c in w], np.uint64)), np.array([0]), np.array([len(w)]))[0])
                     for w in words], np.uint64)


_unit_codes: list[np.ndarray] = []


def tokens(data: np.ndarray, offs: np.ndarray):
    """Per word: (text, hash of the lower-case word, kind, kind when a capital that opens a
    sentence is a name, span start, span end), and the sums that give the hash of any span."""
    cps, at = code_points(data, offs)
    cls, lower = char_tables()
    kind = cls[cps]
    letter, digit = (kind == 1) | (kind == 2), kind == 3
    edge = np.zeros(len(cps) + 1, bool)
    edge[at] = True
    begin = letter | digit
    begin[1:] &= ~((letter[1:] & letter[:-1]) | (digit[1:] & digit[:-1])) | edge[1:-1]
    end = letter | digit
    end[:-1] &= ~((letter[1:] & letter[:-1]) | (digit[1:] & digit[:-1])) | edge[1:-1]
    s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    doc = np.searchsorted(at, s, "right") - 1
    sums = prefix_sums(lower[cps])
    code = span_hash(sums, s, e)
    stops = np.concatenate([[0], np.cumsum(STOPS[cps])])
    opens = np.ones(len(s), bool)  # first word of its sentence
    opens[1:] = (doc[1:] != doc[:-1]) | (stops[s[1:]] > stops[e[:-1]])
    typ = np.zeros(len(s), np.int8)
    typ[digit[s]] = NUM
    named = typ.copy()
    named[kind[s] == 2] = NAME
    typ[(kind[s] == 2) & ~opens] = NAME
    if not _unit_codes:
        _unit_codes.append(np.sort(_code(UNITS)))
    after = np.zeros(len(s), bool)
    after[1:] = (typ[:-1] == NUM) & (doc[1:] == doc[:-1])
    unit = after & ~digit[s] & np.isin(code, _unit_codes[0])
    typ[unit] = named[unit] = UNIT
    return doc, code, typ, named, s, e, sums


def windows(data: np.ndarray, offs: np.ndarray, widths: list[int], literals: int, wide: int, among: np.ndarray | None = None):
    """(text, form 0 plain / 1 template / 2 template with opening capitals as names, place, width,
    hash, slots [rows, max width], places in the text).  Windows of more than ``wide`` words need
    one literal word.  With ``among`` (sorted) only windows whose hash is in it."""
    doc, code, *types, s, e, sums = tokens(data, offs)
    most = max(widths)
    out = []
    for form in (0, 1, 2):
        if form:
            typ = types[form - 1]
            head = np.ones(len(doc), bool)
            head[1:] = ~((typ[1:] == typ[:-1]) & (typ[1:] > 0) & (doc[1:] == doc[:-1]))
            lead = np.flatnonzero(head)
            last = np.append(lead[1:], len(doc))[: len(lead)] - 1
            held = typ[lead]
            d = doc[lead]
            value = np.where(held > 0, span_hash(sums, s[lead], e[last]), np.uint64(0))
            c = np.where(held > 0, HOLDERS[held], code[lead])
        else:
            d, c, held, value = doc, code, np.zeros(len(doc), np.int8), np.zeros(len(doc), np.uint64)
        n = len(d)
        first = np.searchsorted(d, np.arange(len(offs) - 1))
        size = np.diff(np.append(first, n))
        run, free = prefix_sums(c), np.concatenate([[0], np.cumsum(held == 0)])
        for w in widths:
            if n < w:
                continue
            i = np.flatnonzero(d[w - 1:] == d[:n - w + 1])
            if form:
                enough = free[i + w] - free[i]
                i = i[enough >= (min(literals, w) if w <= wide else 1)]
            code_of = span_hash(run, i, i + w)
            if among is not None:  # before the slots, which are as wide as the widest window
                near = np.minimum(np.searchsorted(among, code_of.view(np.int64)), max(0, len(among) - 1))
                hit = among[near] == code_of.view(np.int64) if len(among) else np.zeros(len(i), bool)
                i, code_of = i[hit], code_of[hit]
            slots = np.zeros((len(i), most), np.uint64)
            if form:
                for k in range(w):
                    slots[:, k] = value[i + k]
            out.append((d[i], np.full(len(i), form), i - first[d[i]], np.full(len(i), w), code_of, slots, size[d[i]]))
    if not out:
        return [np.empty(0, np.int64)] * 4 + [np.empty(0, np.uint64), np.empty((0, most), np.uint64), np.empty(0, np.int64)]
    return [np.concatenate(x) for x in zip(*out)]


def item_windows(data: np.ndarray, offs: np.ndarray, width: int, literals: int):
    """Windows that stand for an item: of ``width`` words, or the whole of a shorter item.  A form
    without a window of enough literal words takes the first of twice, four times ... that
    width that has one, else its whole template if that has one literal word."""
    def whole(got, w):
        return (got[3] == w) | ((got[6] == got[3]) & (got[3] < w))

    key = lambda g: g[0] * 3 + g[1]
    got = windows(data, offs, list(range(1, width + 1)), literals, width)
    out = [[x[whole(got, width)] for x in got]]
    bare = windows(data, offs, [1], 0, 1)  # every place
    todo, first = np.unique(key(bare), return_index=True)
    size = bare[6][first]
    w = width
    while len(todo):
        left = ~np.isin(todo, key(out[-1])) & (size > width)
        todo, size = todo[left], size[left]
        if not (size > w).any():
            break
        w *= 2
        got = windows(data, offs, [w], literals, w)
        keep = np.isin(key(got), todo)
        out.append([x[keep] for x in got])
    if len(todo):
        got = windows(data, offs, np.unique(size).tolist(), literals, width)
        keep = np.isin(key(got), todo) & (got[6] == got[3])
        out.append([x[keep] for x in got])
    most = max(x[5].shape[1] for x in out)
    for x in out:
        x[5] = np.pad(x[5], ((0, 0), (0, most - x[5].shape[1])))
    return [np.concatenate(x) for x in zip(*out)]


SCHEMA = "id long, form int, place long, width int, hash long, slots array<long>, words long"


def window_rows(rows: DataFrame, widths: list[int] | int, literals: int, among: np.ndarray | None = None,
                wide: int | None = None) -> DataFrame:
    """Windows of (id, text), those that stand for an item without ``wide``; only those whose hash is in
    the sorted array ``among`` if given."""
    sc = rows.sparkSession.sparkContext
    shared = None if among is None else sc.broadcast(among)

    def run(batches):
        wanted = None if shared is None else shared.value
        for part, data, offs in text_slices(batches, ["id"], "text", 2 << 20):
            text, form, place, width, code, slots, words = (
                item_windows(data, offs, widths, literals) if wide is None else windows(data, offs, widths, literals, wide, wanted))
            code = code.view(np.int64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(text) + 1, dtype=np.int32) * slots.shape[1], pa.int32()),
                                            pa.array(slots.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(text)), pa.array(form.astype(np.int32)), pa.array(place), pa.array(width.astype(np.int32)),
                 pa.array(code), flat, pa.array(words)], names=["id", "form", "place", "width", "hash", "slots", "words"])

    return arrow_map(rows, run, SCHEMA)


def usual(slot: np.ndarray, value: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, the value that each most often stands for), counted by windows of the item."""
    each = np.unique(np.column_stack([slot, value, i]), axis=0)
    both, n = np.unique(each[:, :2], axis=0, return_counts=True)
    both = both[np.lexsort((both[:, 1], n, both[:, 0]))]
    last = np.append(both[1:, 0] != both[:-1, 0], True)
    return both[last, 0], both[last, 1]


def best_reading(i: np.ndarray, at: np.ndarray, match: np.ndarray, item_value: np.ndarray, value: np.ndarray) -> tuple[int, int]:
    """(windows that agree, slot values changed) under the best assignment of values to an item's
    values.  Match k has the item's window ``i[k]`` in the alignment ``at[k]``; its slots are
    the rows of ``match``, ``item_value`` and ``value`` with ``match`` k.

    Assignments tried: the most frequent values of the whole document, and those of each
    alignment; values that an alignment does not show come from the nearest alignments that
    do not contradict it (words put in or left out move the rest to another alignment)."""
    most = len(np.unique(i))
    names, slot = np.unique(item_value, return_inverse=True)
    order = np.argsort(at[match], kind="stable")
    match, slot, value = match[order], slot[order], value[order]
    place, window = at[match], i[match]
    means, known = np.zeros(len(names), np.int64), np.zeros(len(names), bool)

    def against():
        bad = np.zeros(len(i), bool)
        bad[match[known[slot] & (means[slot] != value)]] = True
        return bad

    def learn(rows):
        k, v = usual(slot[rows], value[rows], window[rows])
        means[k], known[k] = v, True

    def judged():
        return len(np.unique(i[~against()])), int((means != names)[known].sum())

    if not len(match):
        return most, 0
    learn(slice(None))
    best, tried = judged(), set()
    places, first = np.unique(place, return_index=True)
    for here, lo, hi in zip(places, first, np.append(first[1:], len(place))):
        if best[0] == most:
            break
        means[:], known[:] = 0, False
        learn(slice(lo, hi))
        if known.all():
            if means.tobytes() in tried:
                continue
            tried.add(means.tobytes())
        while not known.all():
            rest = np.flatnonzero(~known[slot] & ~against()[match])
            if not len(rest):
                break
            learn(rest[place[rest] == place[rest[np.abs(place[rest] - here).argmin()]]])
        best = max(best, judged(), key=lambda r: r[0])
    return best


def read_slots(near: DataFrame) -> DataFrame:
    """(doc_id, item_id, form, n, got, changed) of rows with matches ``m``."""
    def run(batches):
        for batch in batches:
            got = []
            for m in batch.column(4).to_pylist():
                slots = [(k, a, b) for k, r in enumerate(m) if r["at"] is not None
                         for a, b in zip(r["item_slots"], r["slots"]) if a]
                cols = np.array(slots, np.int64).reshape(-1, 3)
                got.append(best_reading(np.array([r["i"] for r in m], np.int64), np.array([r["at"] or 0 for r in m], np.int64),
                                        cols[:, 0], cols[:, 1], cols[:, 2]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *[pa.array([g[k] for g in got], pa.int64()) for k in (0, 1)]],
                                             names=["doc_id", "item_id", "form", "n", "got", "changed"])

    return arrow_map(near, run, "doc_id long, item_id long, form int, n long, got long, changed long")


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 5, share: float = 0.8, literals: int = 3,
                 filter_windows: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, kind, share, windows, slots_changed) of each contaminated pair of a row of
    ``docs`` and a row of ``benchmark``, both judged by themselves, whatever their ids."""
    named = row_keys(benchmark.select(F.col("item_id").cast("long").alias("item"), F.col("text").cast("string").alias("text")).distinct(), "id", "item")
    keyed = row_keys(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "id")
    texts, items = keyed.select("id", "text"), named.select("id", "text")
    bench = cut_lineage(window_rows(items, width, literals), "item-windows")
    sizes = [r[0] for r in bench.select("width").distinct().collect()] or [width]  # width, and lengths of items without a window
    few = bench.select("hash").distinct().limit(filter_windows + 1).count() <= filter_windows
    among = None
    if few:
        among = np.sort(np.array(bench.select("hash").distinct().toPandas()["hash"], np.int64))  # filter_windows at most
    hits = window_rows(texts, sorted(sizes), literals, among, width)
    b = bench.select("hash", "form", "width", F.col("id").alias("item_id"), F.col("place").alias("i"), F.col("slots").alias("item_slots"))
    bare = (F.col("form") == 0) | F.forall("item_slots", lambda v: v == 0)
    unless = lambda c: F.when(~bare, c)  # noqa: E731  a window without slots says the same wherever it stands
    found = cut_lineage(hits.withColumnRenamed("id", "doc_id").join(b, ["hash", "form", "width"])
                        .select("doc_id", "item_id", "form", "i", unless(F.col("place") - F.col("i")).alias("at"),
                                unless(F.col("slots")).alias("slots"), unless(F.col("item_slots")).alias("item_slots")).distinct(),
                        "window-matches")
    total = bench.groupBy(F.col("id").alias("item_id"), "form").agg(F.countDistinct("place").alias("n"))  # windows that can match
    near = (found.groupBy("doc_id", "item_id", "form").agg(F.collect_list(F.struct("i", "at", "item_slots", "slots")).alias("m"))
            .join(total, ["item_id", "form"])
            .where(F.size(F.array_distinct(F.col("m.i"))) >= share * F.col("n")))  # no reading holds more windows
    read = read_slots(near.select("doc_id", "item_id", "form", "n", "m")).where(F.col("got") >= share * F.col("n"))
    part = F.col("got") / F.col("n")
    pairs = cut_lineage(read.groupBy(F.col("doc_id").alias("_doc"), F.col("item_id").alias("_item")).agg(
        F.when(F.min("form") == 0, F.lit("verbatim")).otherwise(F.lit("re-parameterised")).alias("kind"),
        F.max(part).alias("share"), F.max("got").alias("windows"), F.max("changed").alias("slots_changed")), "pairs")
    # back from rows to ids; a row has few items, an item may have many rows
    pairs = pairs.join(F.broadcast(named.select(F.col("id").alias("_item"), F.col("item").alias("item_id"))) if few else
                       named.select(F.col("id").alias("_item"), F.col("item").alias("item_id")), "_item")
    return pairs.join(keyed.select(F.col("id").alias("_doc"), "doc_id"), "_doc").select(
        "doc_id", "item_id", "kind", "share", "windows", "slots_changed")
