"""Main text of pages: what their markup says, less what repeats on the host.

1. A page is cut into blocks. Blocks of an article or main element are the main
   text; menus, adverts, forms and the like are known chrome; others are open.
2. All blocks, articles included, are one token stream of their page. Strings of
   ``run`` tokens on more than ``page_share`` of the distinct pages of a host, and
   on ``min_pages`` at least, are boilerplate; near copies and quotations on fewer
   pages are not. Each string has an anchor (its three-token piece with the least hash), which is on as many
   pages as the string at least, so only anchors on that many rows are followed. The surroundings of
   an anchor on a host form one shard, equal ones counted first. A shard's suffix
   array, built by induced sorting, and its permuted common prefixes give the runs
   of suffixes that pages share; the pages of each such string are then counted.
3. The main blocks of a page, or its open ones if it has none, stay unless they are
   ``share`` covered by boilerplate. An article that is boilerplate for more than
   ``copy`` of its words is a copy of what the host's other pages carry, and stays whole.

Pages with equal html count as one when pages are counted. Null html is empty and
gives an empty text. A null address is a host of its own. Rows may repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from terraweave.llm.html_blocks import MAIN, OPEN, blocks
from terraweave.llm.store import column_values
from terraweave.llm.suffix_arrays import CELLS, permuted_prefixes, sorted_suffixes
from terraweave.llm.tokens import chunks, mix, ngrams, slide, words
from terraweave.session import cut

RUN = 6
PIECE = 3
SHARE = 0.8
PAGE_SHARE = 0.5
MIN_PAGES = 5
COPY = 0.5
NONE = np.uint64(2 ** 64 - 1)


def host_of(url: Column) -> Column:
    """Lower-case host of an address without user and port; null if it has none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(F.length(host) > 0, host)


def site_of(host: Column) -> Column:
    return F.xxhash64(F.coalesce(host, F.lit("")))


def _kept_kind(found: list[tuple[str, str]]) -> str:
    return MAIN if any(kind == MAIN for kind, _ in found) else OPEN


def _anchors(found: list[list[tuple[str, str]]], run: int) -> tuple[np.ndarray, ...]:
    """Of the streams of pages with the blocks ``found``: (word keys, bounds of pages, bounds of blocks, page of each word,
    places of the anchors of all strings of ``run`` words, their keys)."""
    reach = run - PIECE
    keys, edges = words([text for page in found for _, text in page])
    bounds = edges[np.concatenate([[0], np.cumsum([len(page) for page in found])])]
    n = len(keys)
    owner = np.repeat(np.arange(len(found)), np.diff(bounds))
    left = bounds[1:][owner] - np.arange(n)
    piece = np.concatenate([ngrams(keys, PIECE), np.full(min(n, PIECE - 1), NONE)]) | np.uint64(1)
    piece[left < PIECE] = NONE
    least = slide(np.concatenate([piece, np.full(reach, NONE)]), reach + 1, np.minimum) if n else piece
    least[left < run] = 0  # no string starts here
    greatest = slide(np.concatenate([np.zeros(reach, np.uint64), least]), reach + 1, np.maximum) if n else piece
    at = np.flatnonzero((greatest == piece) & (piece != NONE))
    return keys, bounds, edges, owner, at, piece[at]


def _slot(anchors: np.ndarray) -> np.ndarray:
    return (anchors >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _frequent(pages: DataFrame, totals: DataFrame, run: int, page_share: float, min_pages: int) -> DataFrame:
    """(site, slots): the upper halves of anchors on enough rows of a host to hold boilerplate.

    Rows are no fewer than pages, and a slot is no rarer than its anchors, so none is lost. On average a host keeps no
    more than its pages have anchors, divided by ``page_share``.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html"):
            sites = np.array(column_values(batch, "site"), dtype=np.int64)
            _, _, _, owner, at, keys = _anchors([blocks(page or "") for page in column_values(batch, "html")], run)
            names, of_page = np.unique(sites, return_inverse=True)
            slot = _slot(keys).view(np.uint32).astype(np.uint64)
            once = np.unique(owner[at].astype(np.uint64) << np.uint64(32) | slot)  # a page counts an anchor once
            packed, n = np.unique(of_page[(once >> np.uint64(32)).astype(np.int64)].astype(np.uint64) << np.uint64(32)
                                  | (once & np.uint64(0xFFFFFFFF)), return_counts=True)
            yield pa.RecordBatch.from_arrays([
                pa.array(names[(packed >> np.uint64(32)).astype(np.int64)]),
                pa.array((packed & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)),
                pa.array(n.astype(np.int32))], ["site", "slot", "n"])

    counts = pages.select("site", "html").mapInArrow(count, "site long, slot int, n int")
    often = counts.groupBy("site", "slot").agg(F.sum("n").alias("rows")).where(F.col("rows") >= min_pages)
    return (often.join(totals.where(F.col("total") >= min_pages), "site").where(F.col("rows") > page_share * F.col("total"))
            .groupBy("site").agg(F.collect_list("slot").alias("slots")))


def _surroundings(pages: DataFrame, run: int) -> DataFrame:
    """(uid, site, anchor, code, pos, open, tokens): surroundings of the anchors of a page that its host's ``slots`` name.

    ``open`` if a block that may be kept is in them.
    """
    reach = run - PIECE

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html"):
            uids, sites = (np.array(column_values(batch, c), dtype=np.int64) for c in ("uid", "site"))
            found = [blocks(page or "") for page in column_values(batch, "html")]
            keys, bounds, edges, owner, at, anchor = _anchors(found, run)
            kept = [kind == kept for page in found for kept in [_kept_kind(page)] for kind, _ in page]
            inside_kept = np.concatenate([[0], np.cumsum(np.repeat(np.array(kept, dtype=bool), np.diff(edges)))])
            slots, wanted = _slot(anchor), np.zeros(len(at), dtype=bool)
            cuts = np.searchsorted(owner[at], np.arange(len(found) + 1))
            for i, named in enumerate(column_values(batch, "slots")):
                own = slice(cuts[i], cuts[i + 1])
                wanted[own] = np.isin(slots[own], np.array(named, dtype=np.int32))
            at, anchor = at[wanted], anchor[wanted]
            lo = np.maximum(bounds[:-1][owner[at]], at - reach)
            size = np.minimum(bounds[1:][owner[at]], at + run) - lo
            ends = np.concatenate([[0], np.cumsum(size)])
            inside = np.repeat(lo - ends[:-1], size) + np.arange(ends[-1])
            code = size.astype(np.uint64)
            for k in range(run + reach):
                more = size > k
                code[more] = mix(code[more], keys[lo[more] + k])
            rows = owner[at]
            yield pa.RecordBatch.from_arrays([
                pa.array(uids[rows]), pa.array(sites[rows]), pa.array(anchor.view(np.int64)), pa.array(code.view(np.int64)),
                pa.array((lo - bounds[:-1][rows]).astype(np.int32)), pa.array(inside_kept[lo + size] > inside_kept[lo]),
                pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(keys[inside].view(np.int64)))],
                ["uid", "site", "anchor", "code", "pos", "open", "tokens"])

    return pages.select("uid", "site", "html", "slots").mapInArrow(
        split, "uid long, site long, anchor long, code long, pos int, open boolean, tokens array<long>")


def _shared_strings(groups: list[list[dict]], run: int) -> list[list[list[int]]]:
    """For each surrounding of each group, the offsets of strings that at least two pages have."""
    out: list[list[list[int]]] = [[[] for _ in group] for group in groups]
    order = sorted(range(len(groups)), key=lambda g: sum(len(c["tokens"]) + 1 for c in groups[g]))
    sizes = np.array([sum(len(c["tokens"]) + 1 for c in groups[g]) for g in order], dtype=np.int64)
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi - lo + 1) * sizes[hi] <= CELLS and sizes[hi] <= 1.5 * sizes[lo] + 64:
            hi += 1
        shape = (hi - lo, int(sizes[hi - 1]))
        text, owner, offset = np.zeros(shape, np.int64), np.full(shape, -1, np.int64), np.zeros(shape, np.int64)
        for r, g in enumerate(order[lo:hi]):
            codes: dict[int, int] = {}
            at = 0
            for i, one in enumerate(groups[g]):
                n = len(one["tokens"])
                text[r, at:at + n] = [codes.setdefault(t, len(codes) + 2) for t in one["tokens"]]
                text[r, at + n] = 1
                owner[r, at:at + n - run + 1], offset[r, at:at + n - run + 1] = i, np.arange(max(n - run + 1, 0))
                at += n + 1
            text[r, at - 1] = 0
        sa = sorted_suffixes(text, sizes[lo:hi], run)
        prefix = permuted_prefixes(text, sa, run)
        row, rank = np.nonzero(sa >= 0)
        place = sa[row, rank]
        new = (prefix[row, place] < run) | (rank == 0)
        of_run, starts = np.cumsum(new) - 1, np.flatnonzero(new)
        who = owner[row, place]
        ends = {"low": np.full(len(who), 2 ** 63 - 1, np.int64), "high": np.full(len(who), -2 ** 63, np.int64)}
        for k in np.flatnonzero(who >= 0).tolist():
            one = groups[order[lo + row[k]]][who[k]]
            ends["low"][k], ends["high"][k] = one["low"], one["high"]
        several = np.minimum.reduceat(ends["low"], starts) < np.maximum.reduceat(ends["high"], starts)
        for k in np.flatnonzero(several[of_run] & (who >= 0)).tolist():
            out[order[lo + row[k]]][who[k]].append(int(offset[row[k], place[k]]))
        lo = hi
    return out


def boilerplate(pages: DataFrame, run: int = RUN, page_share: float = PAGE_SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """(uid, starts): positions in a page's stream of strings on more than ``page_share`` of the host's pages.

    Only those in or near blocks that may be kept. ``pages``: uid, site, html.
    """
    totals = cut(pages.select("site", "uid").distinct().groupBy("site").agg(F.count(F.lit(1)).alias("total")))
    frequent = cut(_frequent(pages, totals, run, page_share, min_pages))
    around = cut(_surroundings(pages.join(frequent, "site"), run).distinct())
    kinds = around.groupBy("site", "anchor", "code").agg(
        F.min("uid").alias("low"), F.max("uid").alias("high"), F.first("tokens").alias("tokens"))
    groups = kinds.groupBy("site", "anchor").agg(
        F.min("low").alias("_low"), F.max("high").alias("_high"),
        F.collect_list(F.struct("code", "low", "high", "tokens")).alias("kinds")).where("_low < _high")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                site, anchor, held = (column_values(part, c) for c in ("site", "anchor", "kinds"))
                rows = [(h, a, one["code"], starts) for h, a, group, found in zip(site, anchor, held, _shared_strings(held, run))
                        for one, starts in zip(group, found) if starts]
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.list_(pa.int32()))],
                    ["site", "anchor", "code", "offsets"])

    shared = groups.select("site", "anchor", "kinds").mapInArrow(
        solve, "site long, anchor long, code long, offsets array<int>")
    strings = F.transform("offsets", lambda o: F.struct(
        (o + F.col("pos")).alias("start"), F.xxhash64("site", F.slice("tokens", o + 1, run)).alias("string")))
    found = cut(
        around.join(shared, ["site", "anchor", "code"]).select("uid", "site", "open", F.explode(strings).alias("_s"))
        .select("uid", "site", "open", "_s.start", "_s.string"))
    counted = found.select("string", "site", "uid").distinct().groupBy("string", "site").agg(F.count(F.lit(1)).alias("pages"))
    common = (counted.where(F.col("pages") >= min_pages).join(totals, "site")
              .where(F.col("pages") > page_share * F.col("total")).select("string", "site"))
    return (found.where("open").join(common, ["string", "site"], "left_semi")
            .groupBy("uid").agg(F.collect_set("start").alias("starts")))


def _text(page: str | None, starts: list[int], run: int, share: float, copy: float) -> str:
    found = blocks(page or "")
    kept = _kept_kind(found)
    if not starts:
        return "\n".join(text for kind, text in found if kind == kept)
    sizes = np.diff(words([text for _, text in found])[1])
    depth = np.zeros(sizes.sum() + 1, dtype=np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, np.minimum(np.array(starts, dtype=np.int64) + run, sizes.sum()), -1)
    before = np.concatenate([[0], np.cumsum(np.cumsum(depth)[:-1] > 0)])
    ends = np.cumsum(sizes)
    covered = before[ends] - before[ends - sizes]
    own = np.array([kind == kept for kind, _ in found])
    whole = kept == MAIN and covered[own].sum() > copy * sizes[own].sum()
    stays = own & (whole | (covered < share * np.maximum(sizes, 1)))
    return "\n".join(text for (_, text), s in zip(found, stays) if s)


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", run: int = RUN,
              share: float = SHARE, page_share: float = PAGE_SHARE, min_pages: int = MIN_PAGES, copy: float = COPY) -> DataFrame:
    """(page_id, url, text) of every row of ``pages``."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    host = host_of(F.col("url"))
    rows = rows.withColumn("site", site_of(host)).withColumn("uid", F.xxhash64(F.coalesce(host, F.lit("")), "html"))
    starts = cut(boilerplate(rows, run, page_share, min_pages))  # of known size: few articles hold what their host repeats

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html"):
            texts = [_text(page, found or [], run, share, copy)
                     for page, found in zip(column_values(batch, "html"), column_values(batch, "starts"))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url")), pa.array(texts, pa.string())],
                ["page_id", "url", "text"])

    return rows.join(starts, "uid", "left").select("page_id", "url", "html", "starts").mapInArrow(
        extract, "page_id long, url string, text string")
