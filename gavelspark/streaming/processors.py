"""Keyed state machines with timers, over Arrow batches.

What a key brings in a micro-batch comes in parts of bounded size, and so does what is
read from the state; neither is put together.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MILLI = 1000  # event times are microseconds, watermarks and timers are milliseconds


SLICE = 100_000


def _chunks(rows: pd.DataFrame) -> Iterator[tuple]:
    """Rows as values of a state: one array a column, a bounded number of rows at a time."""
    for start in range(0, len(rows), SLICE):
        yield tuple(rows[name].iloc[start : start + SLICE].tolist() for name in rows.columns)


class _Bids:
    """Bids that wait, in list states of arrays. They are read and written a chunk at a time."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, fields: Sequence[str]) -> None:
        self._fields = ["key", *fields]
        kind = ", ".join(f"{field} array<long>" for field in self._fields)
        self._rows, self._aside = handle.getListState(name, kind), handle.getListState(f"{name}_aside", kind)

    def add(self, bids: pd.DataFrame) -> None:
        for chunk in _chunks(bids[self._fields]):
            self._rows.appendList([chunk])

    def take(self, keys: pd.Index) -> Iterator[pd.DataFrame]:
        """The bids on some auctions, which go. All chunks have to be taken."""
        if not self._rows.exists():
            return
        for row in self._rows.get():
            bids = self._frame(row)
            own = bids["key"].isin(keys)
            if own.any():
                yield bids[own]
            for chunk in _chunks(bids[~own]):
                self._aside.appendList([chunk])
        self._rows.clear()
        if self._aside.exists():
            for row in self._aside.get():
                self._rows.appendList([tuple(row)])
            self._aside.clear()

    def drop(self, keys: pd.Index) -> None:
        for _ in self.take(keys):
            pass

    def _frame(self, row: tuple) -> pd.DataFrame:
        return pd.DataFrame({field: pd.Series(values, dtype="int64") for field, values in zip(self._fields, row)})


class _Auctions(StatefulProcessor):
    """What the machines with a timer at an auction's end share. A key of theirs is a part of the auctions.

    The auctions of a part are a table, whose columns are kept as arrays, and a micro-batch costs a part a few
    calls of the state, not some for each auction. A part has one timer, at the first time at
    which something in it is due; then all that the watermark has passed is.
    """

    TABLE: dict[str, str]
    FIELDS: Sequence[str]

    def __init__(self, hold: int) -> None:
        self._hold_ms = hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._table = handle.getValueState("auction", ", ".join(f"{name} array<{kind}>" for name, kind in {"key": "long", **self.TABLE}.items()))
        # bids of auctions that are not known yet, and until when they wait
        self._early = _Bids(handle, "early", self.FIELDS)
        self._until = handle.getValueState("until", "key array<long>, ms array<long>")

    def _load(self) -> None:
        """The part's auctions and waits, by key."""
        self._open = self._read(self._table, self.TABLE)
        self._waits = self._read(self._until, {"ms": "long"})["ms"]
        self._was_due = self._due()

    def _save(self) -> None:
        self._write(self._table, self._open)
        self._write(self._until, self._waits.to_frame())
        due = self._due()
        if due is not None and due != self._was_due:
            self._handle.registerTimer(due)

    @staticmethod
    def _read(state, kinds: dict[str, str]) -> pd.DataFrame:
        rows = state.get() if state.exists() else [()] * (len(kinds) + 1)
        columns = {name: pd.array(values, dtype=_DTYPES[kind]) for (name, kind), values in zip(kinds.items(), rows[1:])}
        return pd.DataFrame(columns, index=pd.Index(rows[0], dtype="int64", name="key"))

    @staticmethod
    def _write(state, rows: pd.DataFrame) -> None:
        if len(rows):
            values = [[None if v is pd.NA else v for v in rows[name].tolist()] for name in rows.columns]
            state.update((rows.index.tolist(), *values))
        elif state.exists():
            state.clear()

    def _due(self) -> int | None:
        """The first time at which something is due, in milliseconds."""
        ends = [int(times.min()) for times in (self._ends(), self._waits) if len(times)]
        return min(ends, default=None)

    def _ends(self) -> pd.Series:
        return _all_up_to_millis(self._open["expires_us"])

    def _set(self, auctions: pd.DataFrame) -> pd.Index:
        """Take the newest version of each auction; the keys."""
        newest = auctions.loc[auctions.groupby("key")["seq"].idxmax()].set_index("key")
        rows = self._version(newest)
        self._open = pd.concat([self._open.drop(index=newest.index, errors="ignore"), rows])[list(self.TABLE)]
        return newest.index

    def _version(self, newest: pd.DataFrame) -> pd.DataFrame:
        """The table's rows of some new versions."""
        raise NotImplementedError

    def _offer(self, bids: pd.DataFrame) -> Iterable[pd.DataFrame]:
        """Bids on known auctions; what they give."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        for part in rows:
            part = part.reset_index(drop=True)
            auctions, bids = part[part["is_auction"]], part[~part["is_auction"]][["key", *self.FIELDS]].astype("int64")
            if len(auctions):
                waited = self._set(auctions).intersection(self._waits.index)
                if len(waited):
                    for held in self._early.take(waited):
                        yield from self._offer(held)
                    self._waits = self._waits.drop(index=waited)
            known = bids["key"].isin(self._open.index)
            if known.any():
                yield from self._offer(bids[known])
            if not known.all():
                early = bids[~known]
                self._early.add(early)
                until = _all_up_to_millis(early.groupby("key")["ts_us"].max()) + self._hold_ms
                self._waits = pd.concat([self._waits, until]).groupby(level="key").max()
        self._save()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # the timer itself and what is due before the watermark, as timers are
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        self._load()
        self._was_due = None  # this timer goes
        gone = self._waits.index[self._waits <= now]
        if len(gone):
            self._early.drop(gone)
            self._waits = self._waits.drop(index=gone)
        yield from self._ended(now)
        self._save()

    def _ended(self, now: int) -> Iterable[pd.DataFrame]:
        """What the auctions give whose end has passed."""
        raise NotImplementedError


_DTYPES = {"long": "Int64", "boolean": "boolean"}


def _all_up_to_millis(micros: pd.Series) -> pd.Series:
    return -(-micros // MILLI)


class ExpiryTimer(_Auctions):
    """Bids before their auction's end at once, the others when its end passes.

    A timer at the end releases what is left. The auction stays for ``hold`` milliseconds
    more, so that bids which arrive later still are told apart; bids of an auction that has
    not come wait as long. Then the state is cleared.
    """

    TABLE = {"expires_us": "long", "kept": "long", "over": "boolean"}
    FIELDS = ("price", "bidder", "ts_us")

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        # bids that wait for the timer
        self._left = _Bids(handle, "left", self.FIELDS)

    def _ends(self) -> pd.Series:
        # an auction that is over is due again when it has been held
        return super()._ends() + self._open["over"].astype("int64") * self._hold_ms

    def _version(self, newest: pd.DataFrame) -> pd.DataFrame:
        return newest[["expires_us", "kept"]].astype("Int64").assign(over=pd.array([False] * len(newest), dtype="boolean"))

    def _offer(self, bids: pd.DataFrame) -> Iterator[pd.DataFrame]:
        place = self._open.index.get_indexer(bids["key"])
        in_time = bids["ts_us"].to_numpy() < self._open["expires_us"].to_numpy(dtype="int64")[place]
        over = self._open["over"].to_numpy(dtype=bool)[place]
        for told, accepted in ((in_time, True), (~in_time & over, False)):
            if told.any():
                yield self._marked(bids[told], accepted)
        self._left.add(bids[~in_time & ~over])

    def _ended(self, now: int) -> Iterator[pd.DataFrame]:
        ends = super()._ends()
        over = self._open.index[(ends <= now) & ~self._open["over"]]
        if len(over):
            for bids in self._left.take(over):
                yield self._marked(bids, False)
            self._open.loc[over, "over"] = True
        self._open = self._open[~(self._open["over"] & (ends + self._hold_ms <= now))]

    def _marked(self, bids: pd.DataFrame, accepted: bool) -> pd.DataFrame:
        own = self._open.loc[bids["key"], ["expires_us", "kept"]].astype("int64").reset_index(drop=True)
        made = bids.rename(columns={"key": "auction"}).reset_index(drop=True).assign(expires_us=own["expires_us"], kept=own["kept"], accepted=accepted)
        return made[["auction", "price", "bidder", "ts_us", "expires_us", "kept", "accepted"]]


class LateMark(StatefulProcessor):
    """Rows with the watermark of their micro-batch, and whether their window was over by then. No state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        for part in rows:
            late = part["end_us"].notna() & (part["end_us"] <= now * MILLI)
            yield pd.DataFrame({"body": part["body"], "at_us": part["at_us"], "is_late": late, "watermark_ms": now})


class FinalPrice(_Auctions):
    """The best bid before its auction's end, emitted when the end passes; then all state of the auction goes."""

    TABLE = {"expires_us": "long", "owner": "long"}
    FIELDS = ("price", "ts_us")

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self._best = handle.getValueState("top", "key array<long>, price array<long>")

    def _load(self) -> None:
        super()._load()
        self._top = self._read(self._best, {"price": "long"})["price"]

    def _save(self) -> None:
        super()._save()
        self._write(self._best, self._top.to_frame())

    def _version(self, newest: pd.DataFrame) -> pd.DataFrame:
        rows = newest[["expires_us", "owner"]].astype("Int64")
        return rows.assign(owner=rows["owner"].where(newest["owned"]))

    def _offer(self, bids: pd.DataFrame) -> Iterable[pd.DataFrame]:
        ends = self._open["expires_us"].to_numpy(dtype="int64")[self._open.index.get_indexer(bids["key"])]
        best = bids[bids["ts_us"].to_numpy() < ends].groupby("key")["price"].max().astype("Int64")
        self._top = pd.concat([self._top, best]).groupby(level="key").max()
        return ()

    def _ended(self, now: int) -> Iterator[pd.DataFrame]:
        over = self._open[self._ends() <= now]
        sold = over.join(self._top.rename("final"), how="inner")
        if len(sold):
            yield sold.rename_axis("auction").reset_index()[["auction", "owner", "expires_us", "final"]]
        self._open = self._open.drop(index=over.index)
        self._top = self._top.drop(index=sold.index)


# Closed auctions of a seller that are averaged.
LAST_SALES = 10


class LastSales(StatefulProcessor):
    """Closings of an owner in the order of their ends, each with the average of the last ``n``; a ring of ``n`` prices is kept.

    Ends arrive in order from one micro-batch to the next, as timers do; within one they are sorted.
    """

    def __init__(self, n: int) -> None:
        self._n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._ring = handle.getListState("ring", "final long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["expires_us", "auction"], kind="stable", ignore_index=True)
        held = [row[0] for row in self._ring.get()] if self._ring.exists() else []
        prices = pd.Series([*held, *new["final"].astype("int64").tolist()], dtype="int64")
        self._ring.put([(int(price),) for price in prices.tail(self._n)])
        recent = prices.cumsum() - prices.cumsum().shift(self._n, fill_value=0)
        place = prices.index.to_series() + 1
        sales = place.where(place < self._n, self._n)
        made = new.assign(sales=sales[len(held) :].to_numpy(), avg_final=(recent / sales)[len(held) :].to_numpy())
        yield made[["owner", "auction", "expires_us", "final", "sales", "avg_final"]]


class WatermarkBuffer(StatefulProcessor):
    """Bids on a live auction at once; others wait for the next version of the auction, which releases all of them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._auction = handle.getValueState("auction", "expires_us long, owner long")
        self._waiting = handle.getListState("waiting", "price array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * MILLI
        arrived = pd.concat(list(rows)).sort_values("seq", ignore_index=True)
        known = [self._auction.get()] if self._auction.exists() else []
        new = arrived[arrived["is_auction"]]
        # the version that is known, if there is one, and those that arrive
        versions = pd.DataFrame({
            "expires_us": pd.array([*[v[0] for v in known], *new["expires_us"].astype("int64").tolist()], dtype="int64"),
            "owner": pd.array([*[v[1] for v in known], *[_whole(x) for x in new["owner"]]], dtype="Int64"),
        })
        if len(new):
            if self._waiting.exists():
                for row in self._waiting.get():
                    yield self._joined(key, pd.Series(row[0], dtype="int64"), versions.iloc[[len(known)] * len(row[0])])
                self._waiting.clear()
            last = versions.iloc[-1]
            self._auction.update((int(last["expires_us"]), _whole(last["owner"])))
        bids = arrived[~arrived["is_auction"]]
        # by bid the place of the version that it meets; -1 before the first
        at = arrived["is_auction"].cumsum()[bids.index].to_numpy() + len(known) - 1
        price, expires = bids["price"].astype("int64"), versions["expires_us"].to_numpy()
        met = at >= 0
        live = met.copy()
        live[met] = (bids["ts_us"].to_numpy()[met] < expires[at[met]]) & (expires[at[met]] > now)
        # the others wait for the next version, here or in a later micro-batch
        released = ~live & (at + 1 < len(versions))
        for told, place in ((live, at), (released, at + 1)):
            if told.any():
                yield self._joined(key, price[told], versions.iloc[place[told]])
        for chunk in _chunks(price[~live & ~released].to_frame()):
            self._waiting.appendList([chunk])

    @staticmethod
    def _joined(key, prices: pd.Series, versions: pd.DataFrame) -> pd.DataFrame:
        return versions.assign(auction=key[0], price=prices.to_numpy())[["auction", "price", "expires_us", "owner"]]


class LatestPair(StatefulProcessor):
    """The latest auction and the latest person of a key, at each arrival of either; a snapshot may be there from the start.

    With ``ttl`` (milliseconds of the clock) a side that is not renewed that long is forgotten.
    """

    def __init__(self, ttl: int | None = None) -> None:
        self._ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._item = handle.getValueState("item", ITEM, self._ttl)
        self._person = handle.getValueState("person", PERSON, self._ttl)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for row in initialState.itertuples(index=False):
            if pd.notna(row.item_seq):
                self._item.update((int(row.item_seq), _whole(row.id), _whole(row.category)))
            if pd.notna(row.person_seq):
                self._person.update((int(row.person_seq), _text(row.name), _text(row.city), _text(row.state)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows)).sort_values("seq", ignore_index=True)
        item = self._item.get() if self._item.exists() else None
        person = self._person.get() if self._person.exists() else None
        out = []
        for row in arrived.itertuples(index=False):
            if row.is_item:
                item = (int(row.seq), _whole(row.id), _whole(row.category))
            else:
                person = (int(row.seq), _text(row.name), _text(row.city), _text(row.state))
            if item is not None and person is not None:
                out.append((int(row.seq), *item[1:], *person[1:]))
        if item is not None:
            self._item.update(tuple(item))
        if person is not None:
            self._person.update(tuple(person))
        frame = pd.DataFrame(out, columns=["seq", "id", "category", "name", "city", "state"])
        yield frame.astype({"id": "Int64", "category": "Int64"})


class LatestPairs(StatefulProcessor):
    """``LatestPair`` for a part of the keys: state holds the last row of either kind of each key of the part.

    A micro-batch costs a part a few calls of the state, not some for each key.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._rows = handle.getListState("rows", "rows binary")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._rows.appendList(list(_packed(initialState[PAIR_FIELDS])))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [_unpacked(row[0]) for row in self._rows.get()] if self._rows.exists() else []
        arrived = pd.concat([part[PAIR_FIELDS] for part in rows]).sort_values("seq", kind="stable")
        both = pd.concat([*held, arrived], ignore_index=True)
        # by key, what was held first
        code, _ = pd.factorize(both["key"], use_na_sentinel=False)
        order = np.argsort(code, kind="stable")
        both, code, is_new = both.iloc[order].reset_index(drop=True), code[order], order >= len(both) - len(arrived)
        place, is_item = np.arange(len(both)), both["is_item"].to_numpy(dtype=bool)
        first = np.searchsorted(code, code)
        item, person = (np.maximum.accumulate(np.where(of, place, -1)) for of in (is_item, ~is_item))
        has_item, has_person = item >= first, person >= first
        told = is_new & has_item & has_person
        if told.any():
            items, people = both.iloc[item[told]].reset_index(drop=True), both.iloc[person[told]].reset_index(drop=True)
            seq = both["seq"][told].reset_index(drop=True)
            yield pd.concat([seq, items[["id", "category"]], people[["name", "city", "state"]]], axis=1)
        last = np.append(code[1:] != code[:-1], True)
        left = np.concatenate([item[last & has_item], person[last & has_person]])
        self._rows.put(list(_packed(both.iloc[left])))


PAIR_FIELDS = ["key", "seq", "is_item", "id", "category", "name", "city", "state"]
_PAIR_ROW = pa.schema([("key", pa.string()), ("seq", pa.int64()), ("is_item", pa.bool_()), *[(name, pa.string()) for name in PAIR_FIELDS[3:]]])


def _packed(rows: pd.DataFrame) -> Iterator[tuple]:
    """Rows as Arrow streams of a bounded number of rows."""
    for start in range(0, len(rows), SLICE):
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, _PAIR_ROW) as writer:
            writer.write_table(pa.Table.from_pandas(rows.iloc[start : start + SLICE], _PAIR_ROW, preserve_index=False))
        yield (out.getvalue().to_pybytes(),)


def _unpacked(rows: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(rows)).read_all().to_pandas()


ITEM = "seq long, id long, category long"
PERSON = "seq long, name string, city string, state string"


def _whole(value) -> int | None:
    return None if pd.isna(value) else int(value)


def _text(value) -> str | None:
    return None if pd.isna(value) else str(value)
