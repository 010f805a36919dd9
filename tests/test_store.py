"""Versions of stores: writes cut short at any step, two writers at once, snapshots, clean-up."""

from __future__ import annotations

import json
import threading

import pytest

from stratalog import schemas
from stratalog.operators.upsert import Store, Transaction
from stratalog.versions import Folder, VersionLog

KEY = schemas.KEYS["files"]


def files(spark, *rows):
    return spark.createDataFrame([(s, c, p, k) for s, c, p, k in rows], schemas.TABLES["files"])


def commits(spark, *hashes):
    return spark.createDataFrame([("S", c, k, "", "", "", 0, "") for k, c in enumerate(hashes)], schemas.TABLES["commits"])


def held(store, name="files", at=None):
    return sorted(tuple(r) for r in store.read(name, at).collect())


@pytest.fixture
def store(spark, tmp_path):
    made = Store(spark, str(tmp_path / "store"), parts=2)
    made.upsert("files", files(spark, ("S", "a", "p", 0), ("T", "b", "q", 0)), KEY)
    return made


class Killed(Exception):
    pass


@pytest.mark.parametrize("step", ["before data", "within data", "after data", "before publishing", "within publishing"])
def test_a_write_cut_short_leaves_the_last_version(spark, store, monkeypatch, step):
    before, number = held(store), store.snapshot().version
    add, publish, linked = Transaction._add, VersionLog.publish, Folder._linked

    def killed(*_):
        raise Killed

    def killed_after(*args):
        add(*args)
        raise Killed

    def killed_within(self, name, rows):
        rows.limit(1).write.parquet(f"{self.store.path}/{name}/batch=half")  # some files, no mark of success
        raise Killed

    def aside_only(aside, target, text):
        with open(aside, "x") as out:
            out.write(text[:10])
        raise Killed

    where = {"before data": (Transaction, "_add", killed), "within data": (Transaction, "_add", killed_within), "after data": (Transaction, "_add", killed_after), "before publishing": (VersionLog, "publish", killed), "within publishing": (Folder, "_linked", staticmethod(aside_only))}
    with monkeypatch.context() as patch:
        patch.setattr(*where[step])
        with pytest.raises(Killed):
            store.transact(lambda t: (t.upsert("files", files(spark, ("S", "a", "p", 1)), KEY), t.replace_sources("commits", commits(spark, "x"), ["S"])))
    assert (publish, linked) == (VersionLog.publish, Folder._linked)
    again = Store(spark, store.path)
    assert held(again) == before and again.snapshot().version == number and held(again, "commits") == []
    again.upsert("files", files(spark, ("S", "a", "p", 2)), KEY)
    assert held(again) == [("S", "a", "p", 2), ("T", "b", "q", 0)]
    again.clean(keep=1, grace=0)
    named = {f"{n}/{p.split('/')[0]}" for n, places in again.snapshot().tables.items() for p in places}
    assert set(again.folder.matching("*/batch=*")) == named and held(again) == [("S", "a", "p", 2), ("T", "b", "q", 0)]


@pytest.mark.parametrize("table", ["files", "commits"])
def test_two_writers(spark, store, table):
    """What another writer publishes meanwhile is kept; changes are made again only if it matters to them."""
    other, calls = Store(spark, store.path), []

    def change(t):
        calls.append(t.base.version)
        t.upsert("files", files(spark, ("S", "a", "p", 7)), KEY)
        if len(calls) == 1:
            if table == "files":
                other.upsert("files", files(spark, ("S", "new", "p", 3)), KEY)
            else:
                other.replace_sources("commits", commits(spark, "x"))

    store.transact(change)
    assert len(calls) == (2 if table == "files" else 1)
    assert ("S", "a", "p", 7) in held(store) and (("S", "new", "p", 3) in held(store) or table == "commits")
    assert [r[1] for r in held(store, "commits")] == (["x"] if table == "commits" else [])


def test_a_writer_between_look_and_publish(spark, store, monkeypatch):
    other, publish, calls = Store(spark, store.path), VersionLog.publish, []

    def overtaken(self, number, content):
        if not calls:
            calls.append(number)
            other.upsert("files", files(spark, ("S", "o", "p", 5)), KEY)
        return publish(self, number, content)

    monkeypatch.setattr(VersionLog, "publish", overtaken)
    store.upsert("files", files(spark, ("S", "m", "p", 6)), KEY)
    assert {("S", "o", "p", 5), ("S", "m", "p", 6)} <= set(held(store)) and store.snapshot().version == 3


def test_many_writers(spark, tmp_path):
    path = str(tmp_path / "many")
    failed = []

    def write(k):
        try:
            own = Store(spark, path, parts=2)
            for n in range(3):
                own.append("files", files(spark, (f"S{k}", f"c{n}", "p", n)))
        except Exception as error:
            failed.append(error)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and len(held(Store(spark, path))) == 12
    assert Store(spark, path).snapshot().version == 12


def test_snapshots_stay(spark, store):
    at, rows = store.snapshot(), store.read("files")
    store.upsert("files", files(spark, ("S", "a", "p", 9)), KEY)
    store.delete("files", files(spark, ("T", "b", "q", 0)), KEY)
    assert held(store) == [("S", "a", "p", 9)]
    assert sorted(tuple(r) for r in rows.collect()) == held(store, at=at) == held(store, at=store.snapshot(at.version)) == [("S", "a", "p", 0), ("T", "b", "q", 0)]
    store.clean(keep=3, grace=0)
    assert held(store, at=at) == [("S", "a", "p", 0), ("T", "b", "q", 0)]
    assert store.clean(keep=1, grace=3600) == [], "young files may belong to a write that goes on"
    store.clean(keep=1, grace=0)
    assert held(store) == [("S", "a", "p", 9)] and store.log.numbers() == [store.snapshot().version]


def test_keyed_writes_read_only_what_they_touch(spark, store):
    store.replace_sources("files", files(spark, *[("U", f"c{k}", "p", 0) for k in range(40)]))
    kept = [p for p in store.snapshot().tables["files"] if "=U/" not in p]
    store.upsert("files", files(spark, ("U", "c3", "p", 1)), KEY)
    now = store.snapshot().tables["files"]
    assert set(kept) <= set(now) and len(now) == 4 and len([p for p in now if "=U/" in p]) == 2
    store.insert_absent("files", files(spark, ("U", "c3", "p", 5), ("U", "n", "p", 5), ("U", "n", "p", 5)), KEY)
    assert store.read("files").filter("source_name = 'U' and is_baseline > 0").count() == 2
    store.replace_sources("files", files(spark), ["U", "S"])
    assert held(store) == [("T", "b", "q", 0)]


def test_log_on_a_file_system_that_is_not_local(spark, tmp_path):
    """Without hard links a version appears by a rename that doesn't overwrite."""
    settings = spark._jsc.hadoopConfiguration()
    (tmp_path / "far").mkdir()
    settings.set("fs.viewfs.mounttable.far.link./d", f"file://{tmp_path}/far")
    log = VersionLog(spark, "viewfs://far/d/log")
    assert not log.folder.local and log.last() == (0, {})
    assert log.publish(1, {"a": [1]}) and not log.publish(1, {"a": [2]}) and log.publish(2, {"b": "é"})
    assert log.last() == (2, {"b": "é"}) and log.read(1) == {"a": [1]}
    assert log.forget(1) == [2] and log.numbers() == [2]
    assert not [p.name for p in (tmp_path / "far/log").iterdir() if "aside" in p.name and not p.name.endswith(".crc")]


def test_versions_are_small_json(store):
    text = store.log.folder.read(f"{1:020}.json")
    assert set(json.loads(text)) == {"parts", "tables"} and len(text) < 1000


def test_parts_follow_the_rows(spark, store, monkeypatch):
    """A table is written anew with more parts once they hold too many rows, and keyed writes go on."""
    monkeypatch.setattr(Store, "PART_ROWS", 10)
    store.replace_sources("files", files(spark, *[("U", f"c{k}", "p", 0) for k in range(70)]))
    before = held(store)
    assert store.fit_parts("files") == 8 and store.snapshot().parts["files"] == 8 and held(store) == before
    assert store.fit_parts("files") == 8 and store.snapshot().version == 3
    other = Store(spark, store.path, parts=2)
    other.upsert("files", files(spark, ("U", "c3", "p", 1)), KEY)
    other.delete("files", files(spark, ("U", "c4", "p", 0)), KEY)
    assert len(held(store)) == len(before) - 1 and ("U", "c3", "p", 1) in held(store) and ("U", "c3", "p", 0) not in held(store)
    assert sum("=U/" in p for p in store.snapshot().tables["files"]) <= 8
    store.replace_sources("files", files(spark), ["U"])
    assert held(store) == [("S", "a", "p", 0), ("T", "b", "q", 0)]


def test_keyed_writes_of_numbers_are_hashed_and_deletes_look_at_no_stored_row(spark, store, monkeypatch):
    plans, add = [], Transaction._add

    def looking(self, name, rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return add(self, name, rows)

    def count(self, name, rows, groups=Transaction._groups):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return groups(self, name, rows)

    monkeypatch.setattr(Transaction, "_add", looking)
    monkeypatch.setattr(Transaction, "_groups", count)
    store.upsert("files", files(spark, ("S", "a", "p", 1), ("S", None, "p", 2), ("T", "new", "q", None)), KEY)
    assert not any("SortAggregate" in p for p in plans)
    plans.clear()
    store.delete("files", files(spark, ("T", "b", "q", 0), ("T", "absent", "q", 0), ("S", None, "p", 2)), KEY)
    assert "parquet" not in plans[0].lower()
    assert {tuple(r) for r in store.read("files").collect()} == {("S", "a", "p", 1), ("S", None, "p", 2), ("T", "new", "q", None)}  # no key equals a null
    store.delete("files", spark.createDataFrame([("S",)], "source_name string"), ["source_name"])
    assert held(store) == [("T", "new", "q", None)]
