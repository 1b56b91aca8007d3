"""Landing refresh by manifest (S7) and slot sums under replacement (ST2)."""

import os

import pytest

from plantwise.operators.facts import oee_facts
from plantwise.sources.sheets import read_sheet_csv
from plantwise.streaming import ingest, landing as ld


def sheet(*oees, day="10/01/2024", hour=7):
    return "".join(f"1,m1,{day},1,{hour},x,,50%,50%,50%,30%,{o}%\n" for o in oees)


@pytest.fixture()
def folder(tmp_path):
    path = tmp_path / "landing"
    path.mkdir()

    def land(name, text, at):
        (path / name).write_text(text)
        os.utime(path / name, (at, at))

    return path, land


def batch(spark, path):
    return sorted(round(r.oee, 9) for r in oee_facts(read_sheet_csv(spark, str(path), 12)).collect())


def now(spark, path, **options):
    return sorted(round(r.oee, 9) for r in ingest.refresh_landing(spark, str(path), **options).collect())


OLD, NEW = 1_700_000_000, 1_700_000_100


def test_every_replacement_gives_the_batch_result(spark, folder):
    path, land = folder
    land("a b%20[1].csv", sheet(50, 60), OLD)  # a name that is no pattern and no encoded path
    land("b.csv", sheet(20), OLD)
    steps = [
        ("a b%20[1].csv", sheet(70), NEW),  # shrunk
        ("a b%20[1].csv", "", NEW + 1),  # emptied
        ("a b%20[1].csv", sheet(10, 15), OLD - 50),  # replaced by an older copy
        ("b.csv", sheet(90, 91, 92), NEW),  # grown
        ("b.csv", sheet(20), OLD),  # restored: the very version that landed first
        ("c.csv", sheet(5), OLD),  # new
        ("a b%20[1].csv", sheet(50, 60), OLD),
    ]
    assert now(spark, path) == batch(spark, path)
    for name, text, at in steps:
        land(name, text, at)
        assert now(spark, path) == batch(spark, path), (name, text, at)
    ledger = ingest.landed_rows(spark, str(path))
    assert ledger.refresh() is False  # nothing is read again, emptied files included


def test_only_changed_files_are_read_and_a_touched_file_keeps_its_home(spark, folder, monkeypatch):
    path, land = folder
    for i in range(5):
        land(f"f{i}.csv", sheet(10 + i), OLD)
    ledger = ingest.landed_rows(spark, str(path))
    assert ledger.refresh()
    homes = {r.file_path: r.home for r in ledger.manifest().collect()}
    read = []
    monkeypatch.setattr(ld, "read_sheet_csv", lambda s, names, n: read.extend(names) or read_sheet_csv(s, names, n))
    land("f1.csv", sheet(11), NEW)  # touched
    land("f2.csv", sheet(99), NEW)  # changed
    assert ledger.refresh()
    assert sorted(os.path.basename(n) for n in read) == ["f1.csv", "f2.csv"]
    moved = {os.path.basename(r.file_path) for r in ledger.manifest().collect() if r.home != homes[r.file_path]}
    assert moved == {"f2.csv"}


def test_same_time_and_size_needs_a_deep_refresh(spark, folder):
    path, land = folder
    land("a.csv", sheet(50), OLD)
    assert now(spark, path) == [0.5]
    land("a.csv", sheet(60), OLD)
    assert now(spark, path) == [0.5] and now(spark, path, deep=True) == [0.6] == now(spark, path)


def test_two_refreshes_at_once_add_nothing_twice(spark, folder, monkeypatch):
    path, land = folder
    land("a.csv", sheet(50), OLD)
    land("b.csv", sheet(20), OLD)
    first, second = (ingest.landed_rows(spark, str(path)) for _ in range(2))
    commit, calls = ld.Ledger.commit, []

    def raced(self, number, attempt, kind="landing"):
        calls.append((self is first, number))
        if self is first and len(calls) == 1:  # the other one lands everything before this commit
            assert second.refresh()
        return commit(self, number, attempt, kind)

    monkeypatch.setattr(ld.Ledger, "commit", raced)
    assert first.refresh() is False  # it lost, planned again and found nothing left
    assert calls == [(True, 1), (False, 1)]
    assert len(first.commits()) == 1 and now(spark, path) == [0.2, 0.5]


def test_portions_bound_the_names_on_the_driver(spark, folder, monkeypatch):
    path, land = folder
    monkeypatch.setattr(ld, "FILES_PER_READ", 2)
    for i in range(7):
        land(f"f{i}.csv", sheet(10 + i), OLD)
    assert now(spark, path) == batch(spark, path)


def test_slot_sums_follow_replaced_files_and_folders_stay_bounded(spark, folder, monkeypatch):
    path, land = folder
    monkeypatch.setattr(ld, "COMPACT_AFTER", 4)
    ledger = ingest.landed_slot_sums(spark, str(path))

    def sums(df):
        return sorted((str(r.data), r.hora, r.turno, round(r.oee_sum, 9), round(r.teep_sum, 9), r.n_rows) for r in df.collect())

    def check():
        got = sums(ingest.ingest_slot_sums(spark, str(path)))
        assert got == sums(ingest.slot_sums(oee_facts(read_sheet_csv(spark, str(path), 12))))

    land("base.csv", sheet(*range(10, 40)), OLD)
    check()
    for n in range(9):
        land(f"f{n % 3}.csv", sheet(n, 2 * n, day=f"{10 + n % 2}/01/2024") if n != 5 else "", OLD - n)
        check()
    assert len(ledger.commits()) <= 5
    ledger.grace_s = 0
    ledger.vacuum()
    base = ledger.base.removeprefix("file:")
    count = {k: len([x for x in os.listdir(f"{base}/{k}") if not x.startswith(".")]) for k in ("data", "manifest", "commits", "plans")}
    assert count["data"] <= 6 and count["manifest"] <= 5 and count["commits"] <= 5 and count["plans"] == 0, count
    check()


def test_snapshot_keeps_large_homes_and_merges_small_ones(spark, folder):
    path, land = folder
    ledger = ingest.landed_rows(spark, str(path))
    land("large.csv", sheet(*range(100)), OLD)
    ledger.refresh()
    large = ledger.manifest().first().home
    for i in range(4):
        land(f"s{i}.csv", sheet(i), OLD)
        ledger.refresh()
    assert ledger.compact()
    homes = {os.path.basename(r.file_path): r.home for r in ledger.manifest().collect()}
    assert homes["large.csv"] == large and len(set(homes.values())) == 2 and len(ledger.commits()) == 1
    assert now(spark, path) == batch(spark, path)
    land("s1.csv", sheet(77), OLD)
    assert now(spark, path) == batch(spark, path)


def test_empty_landing_folder(spark, folder):
    path, _ = folder
    assert now(spark, path) == [] and ingest.ingest_slot_sums(spark, str(path)).count() == 0
