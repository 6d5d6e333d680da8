"""The duplicate merge as an ordered fold over rows that stream by, one group after another.

A task holds one merged row and one batch, whatever the length of a group's list. The fold cannot be
cut into ranges that are summed up apart: a row without a date takes none from those it beats, so what
a range makes of an arriving row depends on which of its rows is the first to win, and there are as many
answers as rows. What bounds the list is that each of its rows beats all before it: it has at most as many
rows as there are different completeness values, and never those that only lose."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Completeness, left to right; the first three change as a row is filled.
RANK = ("email", "site", "paid", "direct", "score", "size")
#: Merged rows that leave together.
ROWS_OUT = 2000


class Merged:
    """The surviving row so far, filled from what lost to it. Fields are in the fold's order, the mailbox
    and the site at the places that completeness looks at."""

    __slots__ = ("seq", "at", "fields", "pay", "day_paid", "rank")

    def __init__(self, seq, at, fields, pay, day_paid, rank):
        self.seq, self.at, self.fields, self.pay, self.day_paid, self.rank = seq, at, fields, pay, day_paid, rank

    def fill(self, at, fields, pay, mail: int, site: int) -> None:
        """Takes the earlier date, and what it has not, from a loser."""
        if at is not None and self.at is not None and at < self.at:
            self.at = at
        changed = False
        for i, value in enumerate(self.fields):
            if not value and fields[i]:
                self.fields[i] = fields[i]
                changed = True
        if (pay[0] or pay[1]) and not (self.pay[0] or self.pay[1]):
            self.pay = (pay[0], pay[1], self.pay[2] or pay[2] or "")
            changed = True
        if changed:
            self.rank = (self.fields[mail] != "", self.fields[site] != "", bool(self.pay[0]) or self.day_paid, *self.rank[3:])


def fold_groups(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """rows(merge_key, seq, own, tail, copies, sources) -> one row per merge_key: winner_seq, posted_at,
    the named fields, salary, copies, merged_sources, first_seq. Rows of a group are taken by seq."""
    schema = pa.schema([("merge_key", pa.string()), ("winner_seq", pa.int64()), ("posted_at", pa.int64()), *((n, pa.string()) for n in names),
                        ("salary_min", pa.float64()), ("salary_max", pa.float64()), ("salary_currency", pa.string()),
                        ("copies", pa.int64()), ("merged_sources", pa.list_(pa.string())), ("first_seq", pa.int64())])
    ddl = "merge_key string, winner_seq long, posted_at long, " + ", ".join(f"{n} string" for n in names) + \
          ", salary_min double, salary_max double, salary_currency string, copies long, merged_sources array<string>, first_seq long"

    mail, site, wide = names.index("public_email"), names.index("company_website"), len(names)
    pay = ("salary_min", "salary_max", "salary_currency")
    flat = rows.select(
        "merge_key", "seq", "copies", "sources", "own.winner_seq", "own.posted_at", F.col("own.day_paid"), *(F.col(f"own.rank.{r}").alias(f"rank_{r}") for r in RANK), *(f"own.salary.{c}" for c in pay), *(f"own.{c}" for c in names),
        F.col("tail.posted_at").alias("lost_at"), *(F.col(f"tail.salary.v.{c}").alias(f"lost_{c}") for c in pay), *(F.col(f"tail.{c}.v").alias(f"lost_{c}") for c in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, acc, first, copies, sources, done = None, None, 0, 0, set(), []

        def finished():
            return (key, acc.seq, acc.at, *acc.fields, *acc.pay, copies, sorted(sources), first)
        for batch in batches:
            for own_key, seq, n, own_sources, winner, at, day_paid, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                new = Merged(winner, at, rest[9:9 + wide], tuple(rest[6:9]), day_paid, tuple(rest[:6]))
                if acc is None or own_key != key:
                    if acc is not None:
                        done.append(finished())
                    key, acc, first, copies, sources = own_key, new, seq, 0, set()
                elif new.rank > acc.rank:
                    new.fill(acc.at, acc.fields, acc.pay, mail, site)
                    acc = new
                else:
                    acc.fill(new.at, new.fields, new.pay, mail, site)
                lost = rest[9 + wide:]
                acc.fill(lost[0], lost[4:], lost[1:4], mail, site)
                copies += n
                sources.update(own_sources)
            if len(done) >= ROWS_OUT:
                yield _batch(done, schema)
                done = []
        if acc is not None:
            done.append(finished())
        if done:
            yield _batch(done, schema)
    return flat.repartition("merge_key").sortWithinPartitions("merge_key", "seq").mapInArrow(run, ddl)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
