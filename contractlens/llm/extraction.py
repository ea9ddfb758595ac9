"""Main text of web pages, by repeated runs of a host.

The text of a page is a stream of tokens, cut at its blocks, and the streams
of a host form one suffix array: its suffixes, sorted by their first RUN tokens.  Neighbours that
agree in these are repeats, and a repeat that stands on a good share of the
host's pages is boilerplate, wherever on the page it is.  The union of such runs is what
all longer repeats cover too, so the order beyond RUN tokens is not needed and
suffixes can be grouped by a hash of these tokens, on as many tasks as one
likes for any host.  Only covered tokens are cut; the rest of a block stays.

Repeats of a host are first looked for among few of its suffixes: of WINDOW
neighbouring ones that with the smallest hash.  Any repeat of WINDOW + RUN - 1
tokens, and any block that is repeated whole, has one of them in common.  All
suffixes are compared only on the pages where such a one is found.

Pages count as distinct by their content without marked elements.  A page that
has next to nothing of its own is an edition of other pages, such as an article with another
date line, and stays whole: copies do not empty each other.
"""

from __future__ import annotations

from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contractlens.llm.common import by_slice, limited, mixed, run_hashes, word_hashes, word_lists
from contractlens.llm.markup import BESIDE, blocks
from contractlens.operators.scale import durable

# Tokens of the shortest repeat; a shorter block counts as a whole.
RUN = 5

# A run is boilerplate if it stands on so many distinct pages of its host, and on this share of them.
LEAST_PAGES = 3
SHARE = 0.5

# Of so many neighbouring runs one is looked at first.
WINDOW = 12

# A page of which repeats cover more than this share is an edition of other pages.
EDITION = 0.9

# Boilerplate runs that a pass looks for, 8 bytes each on every executor.  More take more passes, by host.
SOUGHT = 1 << 22

def host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:  # not a URL
        return ""


class Runs:
    """The runs of a slice of pages, given as lists of blocks: their hashes, and where they stand."""

    def __init__(self, pages: list[list[str]]) -> None:
        texts = [text for page in pages for text in page]
        words, self.offsets = word_lists(pa.array(texts, pa.large_string()))
        hashes = word_hashes(words)
        sizes = np.diff(self.offsets)
        self.page = np.repeat(np.arange(len(pages)), [len(p) for p in pages])  # of each block
        # blocks of fewer tokens than a run have one run, the whole block
        counts = np.where(sizes >= RUN, sizes - RUN + 1, 1) * (sizes > 0)
        self.ends = np.cumsum(counts)
        self.block = np.repeat(np.arange(len(texts)), counts)
        begins = self.ends - counts
        self.at = self.offsets[self.block] + np.arange(int(counts.sum())) - begins[self.block]
        self.length = np.minimum(sizes, RUN)[self.block]
        long = run_hashes(hashes, RUN)
        self.hashes = long[np.minimum(self.at, max(len(long) - 1, 0))] if len(long) else np.zeros(len(self.at), np.uint64)
        for n in range(1, RUN):
            short = self.length == n
            if short.any():
                self.hashes[short] = mixed(run_hashes(hashes, n)[self.at[short]] + np.uint64(n))
        self.begins = begins

    def of_pages(self, pages: int) -> list[tuple[int, int]]:
        """Bounds of each page's runs."""
        page = self.page[self.block] if len(self.block) else self.block
        return list(zip(np.searchsorted(page, np.arange(pages)).tolist(), np.searchsorted(page, np.arange(pages), "right").tolist(), strict=True))

    def chosen(self) -> np.ndarray:
        """One run of each WINDOW neighbouring ones of a block, one at least of each block."""
        picked = np.zeros(len(self.hashes), bool)
        if not len(self.hashes):
            return picked
        full = np.flatnonzero(self.ends > self.begins)
        least = np.minimum.reduceat(self.hashes, self.begins[full])
        picked |= self.hashes == np.repeat(least, (self.ends - self.begins)[full])
        if len(self.hashes) >= WINDOW:
            seen = np.lib.stride_tricks.sliding_window_view(self.hashes, WINDOW)
            whole = np.flatnonzero(self.block[WINDOW - 1 :] == self.block[: len(seen)])
            picked[whole + seen[whole].argmin(axis=1)] = True
        return picked


def keys(hosts: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """One number for a run on a host."""
    return mixed(runs ^ mixed(hosts))


_PARSED = "page_id long, url string, host long, content long, blocks array<string>"


def _parse(batch: pa.RecordBatch) -> pa.RecordBatch:
    urls, pages = batch.column("url").to_pylist(), pc.fill_null(batch.column("html"), "").to_pylist()
    kept = [[text for place, text in blocks(html) if place != BESIDE] for html in pages]
    runs = Runs(kept)
    # of the runs in their order, so copies of a page under other ids and addresses count as one
    contents = [int(mixed(runs.hashes[a:b] + mixed(np.arange(b - a, dtype=np.uint64))).sum(dtype=np.uint64)) for a, b in runs.of_pages(len(kept))]
    hosts = word_hashes(pa.array([host(u) for u in urls], pa.large_string())).view(np.int64)
    return pa.RecordBatch.from_arrays(
        [batch.column("page_id"), batch.column("url"), pa.array(hosts), pa.array(np.array(contents, np.uint64).view(np.int64)), pa.array(kept, pa.list_(pa.string()))],
        names=["page_id", "url", "host", "content", "blocks"],
    )


def parsed(pages: DataFrame) -> DataFrame:
    """Host, content, and the blocks that may be main text, of each page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(by_slice("html", _parse), _PARSED)


def _sliced(batch: pa.RecordBatch, rows: int = 256):
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _first_runs(batches):
    """``key, host, content`` of the chosen runs of each page."""
    for batch in batches:
        for part in _sliced(batch):
            runs = Runs(part.column("blocks").to_pylist())
            at = np.flatnonzero(runs.chosen())
            page = runs.page[runs.block[at]]
            hosts = part.column("host").to_numpy().view(np.uint64)
            content = part.column("content").to_numpy()
            rows = np.unique(np.stack([keys(hosts[page], runs.hashes[at]).view(np.int64), hosts[page].view(np.int64), content[page]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, k].copy()) for k in range(3)], ["key", "host", "content"])


def _looked_up(sought, work):
    """For ``mapInArrow``: ``work`` on the pages of a slice, their runs, and which runs are among the sought keys."""

    def run(batches):
        known = sought.value
        for batch in batches:
            for part in _sliced(batch):
                runs = Runs(part.column("blocks").to_pylist())
                hosts = part.column("host").to_numpy().view(np.uint64)
                key = keys(hosts[runs.page[runs.block]], runs.hashes) if len(runs.block) else runs.hashes
                found = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key if len(known) else np.zeros(len(key), bool)
                made = work(part, runs, key, found)
                if made is not None:
                    yield made

    return run


def _runs_of_hit_pages(part: pa.RecordBatch, runs: Runs, key: np.ndarray, found: np.ndarray) -> pa.RecordBatch | None:
    page = runs.page[runs.block] if len(runs.block) else runs.block
    hit = np.unique(page[found])
    at = np.flatnonzero(np.isin(page, hit))
    if not len(at):
        return None
    hosts, content = (part.column(c).to_numpy()[page[at]] for c in ("host", "content"))
    return pa.RecordBatch.from_arrays([pa.array(key[at].view(np.int64)), pa.array(hosts), pa.array(content)], ["key", "host", "content"])


def _cut(part: pa.RecordBatch, runs: Runs, key: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
    """The text of each page without covered tokens."""
    pages = part.column("blocks").to_pylist()
    gone = np.zeros(int(runs.offsets[-1]) + 1, np.int64)
    np.add.at(gone, runs.at[found], 1)
    np.add.at(gone, runs.at[found] + runs.length[found], -1)
    covered = np.cumsum(gone)[:-1] > 0
    texts, no = [], 0
    for page in pages:
        kept = []
        first, last = runs.offsets[no], runs.offsets[no + len(page)]
        if covered[first:last].sum() > EDITION * (last - first):
            no += len(page)
            texts.append(" ".join(page))
            continue
        for text in page:
            low, high = runs.offsets[no], runs.offsets[no + 1]
            no += 1
            mine = covered[low:high]
            if mine.any():
                text = " ".join(w for w, c in zip(text.split(), mine.tolist(), strict=True) if not c)
            if text:
                kept.append(text)
        texts.append(" ".join(kept))
    return pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def _shared(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """``host, key`` of runs that stand on enough of the distinct pages of their host."""
    counted = runs.groupBy("host", "key").agg(F.count_distinct("content").alias("pages"))
    enough = (F.col("pages") >= LEAST_PAGES) & (F.col("pages") >= F.col("all_pages") * SHARE)
    return durable(counted.join(sizes, "host").where(enough).select("host", "key"))


def _in_passes(read: DataFrame, wanted: DataFrame, work, schema: str, rest: bool) -> DataFrame:
    """``work`` on the pages whose hosts are in ``wanted`` (with ``rest`` on all), in passes by host that each look for about SOUGHT keys."""
    passes = max(1, -(-wanted.count() // SOUGHT))
    part = F.pmod(F.xxhash64("host"), F.lit(passes))
    done = None
    for k in range(passes):
        sought = wanted.where(part == k).select("key").toArrow().column(0).to_numpy().view(np.uint64)
        pages = read.where(part == k) if rest else limited(read.where(part == k), wanted.where(part == k), ["host"])
        made = pages.mapInArrow(_looked_up(read.sparkSession.sparkContext.broadcast(np.sort(sought)), work), schema)
        done = made if done is None else done.unionByName(made)
    return done


def boilerplate(read: DataFrame) -> DataFrame:
    """``host, key`` of the runs that are boilerplate, from ``parsed`` pages."""
    sizes = durable(read.where(F.size("blocks") > 0).groupBy("host").agg(F.count_distinct("content").alias("all_pages")))
    rows = "key long, host long, content long"
    first = read.mapInArrow(_first_runs, rows)
    # only what two contents share is counted; both steps combine before they shuffle
    met = first.groupBy("key").agg(F.min("content").alias("lo"), F.max("content").alias("hi")).where("lo < hi").select("key")
    hits = _shared(limited(first, met, ["key"]), sizes)
    if not hits.head(1):
        return hits
    return _shared(_in_passes(read, hits, _runs_of_hit_pages, rows, rest=False), sizes)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages`` (page_id, url, html).

    Menus, headers, footers, asides, forms and elements of such names are left
    out by their markup; of the rest, articles included, the runs of tokens that stand on
    at least ``LEAST_PAGES`` distinct pages of the host and on ``SHARE`` of
    them are cut, but for pages that these would cover to more than ``EDITION``.
    Blocks are joined by one space, in page order.

    NULL and empty html, and pages without main text, give an empty text.  A
    NULL or unreadable URL counts as one host.  Rows are kept one for one, also
    repeated ones; pages of equal text count as one when repeats are looked
    for, so a host of fewer than three different pages loses nothing.
    Pages are read whole, however long.  Other columns are not read.
    """
    read = durable(parsed(pages))
    runs = boilerplate(read)
    if runs.head(1):
        done = _in_passes(read, runs, _cut, "page_id long, url string, text string", rest=True)
    else:
        done = read.select("page_id", "url", F.array_join("blocks", " ").alias("text"))
    return done.withColumn("n_chars", F.length("text").cast("long"))
