import datetime as dt
import json
import pathlib
import warnings

import pytest

from keyloom import ClosedError, CompactionError, IdentityError, IntegrityError, LockLostError, MissingObject, MissingTableError, OfflineError, PushInProgressError, ReadOnlyError, Session, fsck, open_catalog, open_table
from keyloom.functions.grouping import group_column, group_of, next_prime
from keyloom.model import Connection

OLD = 1_000_000_000_000_000


@pytest.fixture
def place(tmp_path):
    return f"file://{tmp_path}/remote", lambda name: str(tmp_path / name)


def seeded(spark, place, groups=5, n=3):
    t = open_table(spark, place[0], place[1]("a"), "n", num_groups=groups)
    t.update({f"k{i}": f"v{i}".encode() for i in range(1, n + 1)})
    assert t.changes().push()
    return t


@pytest.mark.parametrize("groups", [None, 5])
def test_push_and_fresh_reader(spark, place, groups):
    seeded(spark, place, groups).close()
    with open_table(spark, place[0], place[1]("b")) as r:
        assert r["k1"] == b"v1" and r.get("none", 7) == 7 and "k2" in r and len(r) == 3
        assert dict(r.items()) == {"k1": b"v1", "k2": b"v2", "k3": b"v3"}
        assert list(r.get_items(["k3", "x", "k1"], 0)) == [("k3", b"v3"), ("x", 0), ("k1", b"v1")]
        with pytest.raises(KeyError):
            r["none"]
        with pytest.raises(ReadOnlyError):
            r["k"] = b"v"


def test_pending_changes_survive_close_and_push(spark, place):
    t = seeded(spark, place)
    del t["k1"]
    t["k2"] = b"new"
    t["empty"] = b""
    assert "k1" not in t and t["k2"] == b"new"
    t.close()
    t = open_table(spark, place[0], place[1]("a"), "w")
    assert t.changes().pending_deletes() == {"k1"}
    assert t.changes().push() and not t.changes().push()
    t.close()
    with open_table(spark, place[0], place[1]("c")) as r:
        assert dict(r.items()) == {"k2": b"new", "k3": b"v3", "empty": b""}
        assert fsck(spark, place[0], check_rows=True)


def test_discard_clear_and_metadata(spark, place):
    t = seeded(spark, place)
    t.set_metadata({"a": 1})
    del t["k1"]
    t["k2"] = b"x"
    t.changes().discard(["k2"])
    assert t["k2"] == b"v2" and "k1" not in t and t.get_metadata() == {"a": 1}
    t.changes().discard()
    assert len(t) == 3 and t.get_metadata() is None
    t.set_metadata({"a": 2})
    assert t.changes().push()
    t.clear()
    assert len(t) == 0 and t.get_metadata() == {"a": 2}
    assert t.changes().push() and t.head.manifest == {}
    t.close()


def test_skewed_edit_is_restamped(spark, place):
    t = seeded(spark, place)
    t.set("k1", b"late", OLD)
    change = {x["key"]: x for x in t.changes().iter_changes()}["k1"]
    assert change["local_timestamp"] > change["remote_timestamp"]
    assert t.changes().push()
    t.close()
    with open_table(spark, place[0], place[1]("b")) as r:
        assert r["k1"] == b"late"


def test_other_writers_deletes_and_conflicts(spark, place):
    t = seeded(spark, place)
    r = open_table(spark, place[0], place[1]("b"))
    assert r.load_items() == {}
    del t["k1"]
    assert t.changes().push()
    t.close()
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert r.pull() and not r.pull()
    assert "k1" not in r and len(r) == 2
    r.close()
    w = open_table(spark, place[0], place[1]("c"), "w")
    w["k9"] = b"mine"
    assert w.changes().push()
    w.close()


def test_stale_reader_heals_and_damage_is_told(spark, place):
    t = seeded(spark, place, 1)
    r = open_table(spark, place[0], place[1]("b"))
    t["k1"] = b"two"
    assert t.changes().push()
    assert r["k1"] == b"two"
    gen = t.head.manifest[0]
    t.store.delete(f"groups/gen={gen}")
    with pytest.raises(IntegrityError):
        r["k1"]
    assert fsck(spark, place[0]).missing == [f"groups/gen={gen}/gid=0"]
    t.close()
    r.close()


def test_fsck_gives_all_lost_keys(spark, place):
    seeded(spark, place, None, 2500).close()
    assert fsck(spark, place[0], check_rows=True).lost_keys == []
    t = open_table(spark, place[0], place[1]("b"))
    (gid, gen), = t.head.manifest.items()
    t.store.delete(f"groups/gen={gen}")
    report = fsck(spark, place[0], check_rows=True)
    assert not report and report.n_lost == 2500 == report.lost.count()
    assert report.lost_keys == sorted(f"k{i}" for i in range(1, 2501))
    t.close()


def test_replacement(spark, place):
    seeded(spark, place).close()
    t = open_table(spark, place[0], place[1]("n"), "n", num_groups=5)
    t["only"] = b"1"
    with open_table(spark, place[0], place[1]("b")) as r:
        assert len(r) == 3
    assert t.changes().push()
    t["two"] = b"2"
    assert t.changes().push()
    t.close()
    with open_table(spark, place[0], place[1]("c")) as r:
        assert set(r) == {"only", "two"}


def test_failed_write_commits_nothing(spark, place, monkeypatch):
    t = seeded(spark, place)
    t["k1"] = b"x"
    before = t.store.read("HEAD.json")
    from keyloom.operators import views

    def broken(*_):
        raise RuntimeError("disk")

    with monkeypatch.context() as m:
        m.setattr(views, "next_index", broken)
        got = t.changes().push()
    assert not got and set(got.failures.values()) == {"RuntimeError: disk"}
    assert t.store.read("HEAD.json") == before and t["k1"] == b"x"
    assert t.changes().push()
    t.close()


def test_lock(spark, place):
    t = seeded(spark, place)
    with pytest.raises(TimeoutError):
        open_table(spark, place[0], place[1]("b"), "w", lock_timeout=0.1)
    other = open_table(spark, place[0], place[1]("b"), "w", force_lock=True)
    t["k1"] = b"x"
    with pytest.raises(LockLostError):
        t.changes().push()
    other.close()


def test_open_errors(spark, place):
    with pytest.raises(MissingTableError):
        open_table(spark, place[0], place[1]("a"))
    with pytest.raises(TypeError):
        Connection.of(3)
    seeded(spark, place).close()
    open_table(spark, place[0] + "2", place[1]("z"), "n").close()
    with pytest.raises(IdentityError):
        open_table(spark, place[0], place[1]("z"), "w")
    with pytest.raises(TypeError):
        open_catalog(spark, place[0], place[1]("q"))


def test_offline(spark, place):
    seeded(spark, place).close()
    with open_table(spark, place[0], place[1]("b")) as r:
        r.load_items(["k1"])
    with open_table(spark, place[0], place[1]("b"), offline=True) as r:
        assert r["k1"] == b"v1" and len(r) == 3
        with pytest.raises(OfflineError, match="k2, k3"):
            list(r.items())


def test_prune_keeps_pending(spark, place):
    t = seeded(spark, place)
    t["new"] = b"n"
    assert t.prune(9 * 10**15) == 3 and t["new"] == b"n" and t["k1"] == b"v1"
    t.close()


def test_map_copy_delete(spark, place):
    t = seeded(spark, place, 11, 9)
    made = {x.key: bytes(x.value) for x in t.map(lambda k, v: None if k in ("k2", "k4") else ("new_" + k, v * 2)).collect()}
    assert len(made) == 7 and made["new_k1"] == b"v1v1"
    assert [x.key for x in t.map(lambda k, v: (k, v), ["k3"]).collect()] == ["k3"]
    t.copy_remote(place[0] + "-copy")
    with open_table(spark, place[0] + "-copy", place[1]("c")) as r:
        assert len(r) == 9
    t.delete_remote()
    t.close()
    with pytest.raises(MissingTableError):
        open_table(spark, place[0], place[1]("d"))


def test_catalog_and_fsck_sweep(spark, place):
    t = seeded(spark, place)
    t.close()
    with open_catalog(spark, place[0] + "-cat", place[1]("cat"), "n") as c:
        own = c.add({"path": place[0], "options": {"fs.secret": "hidden"}}, user_meta={"owner": "x"})
        assert c[own]["type"] == "table" and "hidden" not in json.dumps(c[own])
        assert c.add(place[0], "named") == "named" and set(c) == {"named"}
        with pytest.raises(ValueError):
            c.add(place[0], "bad!key")
        assert c.entries().first().remote_conn.path == place[0]
    t.store._put("groups/gen=gdead/gid=7/part-0", {})
    assert fsck(spark, place[0]).orphans == ["groups/gen=gdead/gid=7"]
    assert fsck(spark, place[0], delete_orphans=True).deleted == []
    assert fsck(spark, place[0], delete_orphans=True, min_age=0).deleted == ["groups/gen=gdead/gid=7"]


def test_bulk_upsert_last_wins(spark, place):
    t = open_table(spark, place[0], place[1]("a"), "n", "str", num_groups=4)
    t.upsert(spark.createDataFrame([("a", "1", 5), ("a", "2", 9), ("b", "3", 7)], "key string, value string, ts long"))
    assert dict(t.items()) == {"a": "2", "b": "3"} and t.pop("b") == "3" and t.setdefault("c", "x") == "x"
    t.set_timestamp("a", "2020-01-01T00:00:00+00:00")
    assert t.get_timestamp("a") == 1577836800000000
    t.close()


def test_grouping(spark):
    assert [next_prime(n) for n in (1, 2, 3, 4, 10, 11, 100)] == [2, 2, 3, 5, 11, 11, 101]
    assert [group_of(k, 5, "blake2b") for k in ("test", "k1", "k2", "k3")] == [1, 1, 3, 0]
    df = spark.createDataFrame([(str(i),) for i in range(50)], "key string")
    for method in ("md5", "blake2b"):
        assert all(x.g == group_of(x.key, 11, method) for x in df.select("key", group_column("key", 11, method).alias("g")).collect())


@pytest.mark.parametrize("flag", ["r", "w", "c", "n"])
def test_foreign_files_survive(spark, place, flag, tmp_path):
    seeded(spark, place).close()
    mine = tmp_path / "mine"
    (mine / "rows").mkdir(parents=True)
    (mine / "diary.txt").write_text("dear diary")
    with pytest.raises(ValueError, match="diary"):
        open_table(spark, place[0], str(mine), flag)
    assert (mine / "diary.txt").read_text() == "dear diary" and (mine / "rows").is_dir()


def test_replacement_forgets_pending_and_spares_foreign_files(spark, place, tmp_path):
    t = seeded(spark, place)
    t["pending"] = b"x"
    t.close()
    (tmp_path / "a" / "note").write_text("n")
    t = open_table(spark, place[0], place[1]("a"), "n", num_groups=5)
    assert len(t) == 0 and t.changes().changelog().count() == 0 and (tmp_path / "a" / "note").read_text() == "n"
    t.close()


def test_reads_check_lengths(spark, place):
    t = seeded(spark, place, None)
    path = t.store.path(f"index/{t.head.commit}")
    cut = spark.createDataFrame([(x.key, x.ts, x.gid, x.length + (x.key == "k2")) for x in t.index().collect()], "key string, ts long, gid int, length long")
    cut.write.mode("overwrite").parquet(path)
    t.prune(9 * 10**15)
    assert t["k1"] == b"v1" and t.get("none") is None
    with pytest.raises(IntegrityError):
        t["k2"]
    assert t.load_items() == {"k2": "in the index and not whole in its group"}
    assert fsck(spark, place[0], check_rows=True).lost_keys == ["k2"]
    t.close()


def test_progress_is_logged(spark, place, caplog):
    with caplog.at_level("INFO", logger="keyloom"):
        t = seeded(spark, place, None)
    told = [x.getMessage() for x in caplog.records]
    assert told[0] == "push: 1 groups, 3 keys, 55 bytes" and told[1] == "group 0: 3 keys, 55 bytes" and told[2].startswith("written: 1 groups, 55 bytes in ") and told[3].startswith("committed g")
    t.close()


def test_closed_tables_do_nothing(spark, place):
    t = seeded(spark, place)
    t.close()
    for action in (lambda: t.set("k", b"v"), lambda: t["k1"], lambda: len(t), lambda: t.prune(), lambda: t.to_df(), lambda: t.changes().push()):
        with pytest.raises(ClosedError):
            action()


def test_upsert_checks(spark, place):
    t = seeded(spark, place)
    for rows, kind, error in (
        ([("a", "x", 0)], "key string, value string, ts long", ValueError),
        ([("a", "x", None)], "key string, value string, ts long", ValueError),
        ([("a", "x", -5)], "key string, value string, ts long", ValueError),
        ([(None, "x", 5)], "key string, value string, ts long", ValueError),
        ([("__keyloom_x", "x", 5)], "key string, value string, ts long", ValueError),
        ([(7, "x", 5)], "key long, value string, ts long", TypeError),
        ([("a", 7, 5)], "key string, value long, ts long", TypeError),
    ):
        with pytest.raises(error):
            t.upsert(spark.createDataFrame(rows, kind))
    assert len(t) == 3 and t.get(7) is None and 7 not in t
    t.remove(spark.createDataFrame([("k1",), ("none",)], "key string"))
    assert set(t) == {"k2", "k3"} and t.changes().pending_deletes() == {"k1"}
    t.close()


def test_failures_by_group(spark, place, monkeypatch):
    t = seeded(spark, place, 5, 20)
    t.set_metadata({"n": 1})
    for i in range(1, 21):
        t[f"k{i}"] = b"new"
    del t["k7"]
    bad = group_of("k7", 5)
    real = type(t).committed

    def broken(self, gids=None):
        if gids is not None and bad in list(gids):
            raise ConnectionError("no route")
        return real(self, gids)

    with monkeypatch.context() as m:
        m.setattr(type(t), "committed", broken)
        got = t.changes().push()
    assert got.updated and not got and got.failures == {bad: "ConnectionError: no route"}
    inside = {f"k{i}" for i in range(1, 21) if group_of(f"k{i}", 5) == bad}
    with open_table(spark, place[0], place[1]("r")) as r:
        assert {k: v for k, v in r.items()} == {f"k{i}": b"v%d" % i if f"k{i}" in inside else b"new" for i in range(1, 21)}
        assert r.get_metadata() == {"n": 1}
    assert t.changes().pending_deletes() == {"k7"} and {x.key for x in t.changes().changelog().collect()} == inside - {"k7"}
    assert t.changes().push() and "k7" not in t and not t.changes().push()
    t.close()
    with open_table(spark, place[0], place[1]("s")) as r:
        assert set(r.values()) == {b"new"} and len(r) == 19


def test_replacement_fails_whole(spark, place, monkeypatch):
    seeded(spark, place, 5, 20).close()
    t = open_table(spark, place[0], place[1]("n"), "n", num_groups=5)
    t.update({f"x{i}": b"1" for i in range(20)})
    from keyloom.operators import table as module

    monkeypatch.setattr(module, "MOST_GROUP_BYTES", 60)
    got = t.changes().push()
    assert not got.updated and got.failures and all(x.startswith("GroupTooLargeError") for x in got.failures.values())
    monkeypatch.undo()
    with open_table(spark, place[0], place[1]("r")) as r:
        assert len(r) == 20 and "k1" in r
    assert t.changes().push() and len(t) == 20
    t.close()


def test_lost_group_leaves_the_index_with_a_warning(spark, place):
    t = seeded(spark, place, None, 5)
    t["k1"] = b"new"
    t.store.delete(f"groups/gen={t.head.manifest[0]}")
    with pytest.warns(UserWarning, match="4 keys of 1 groups"):
        assert t.changes().push()
    t.close()
    with open_table(spark, place[0], place[1]("r")) as r:
        assert dict(r.items()) == {"k1": b"new"}


def test_load_items_tells_what_is_missing(spark, place):
    t = seeded(spark, place, 5, 20)
    gid, gen = sorted(t.head.manifest.items())[0]
    lost = {f"k{i}" for i in range(1, 21) if group_of(f"k{i}", 5) == gid}
    t.store.delete(f"groups/gen={gen}/gid={gid}")
    t.close()
    r = open_table(spark, place[0], place[1]("r"))
    failed = r.load_items()
    assert set(failed) == lost and all(isinstance(x, MissingObject) and set(x.keys) == lost and not x.exists for x in failed.values())
    with pytest.raises(IntegrityError) as e:
        dict(r.items())
    assert [x.path for x in e.value.missing] == [f"groups/gen={gen}/gid={gid}"]
    assert r.copy_remote(place[0] + "-copy") == {gid: f"groups/gen={gen}/gid={gid} is missing"}
    with pytest.raises(MissingTableError):
        open_table(spark, place[0] + "-copy", place[1]("x"))


def test_stale_readers_heal(spark, place):
    t = seeded(spark, place, 1)
    for n, use in enumerate((lambda r: r.map(lambda k, v: (k, v)).count(), lambda r: r.to_df().count(), lambda r: r.map(lambda k, v: (k, v), ["k1", "k2", "k3"]).count(), lambda r: len(list(r.get_items(["k1", "k2", "k3"]))), lambda r: len(list(r.timestamps())), lambda r: len(r.load_items()) + 3)):
        r = open_table(spark, place[0], place[1](f"r{n}"))
        t["k1"] = b"%d" % n
        assert t.changes().push()
        assert use(r) == 3
        r.close()
    w = open_table(spark, place[0], place[1]("r0"))
    t.delete_remote()
    assert w.get("k1") is None
    t.close()


def test_offline_auto_tells_damage_from_distance(spark, place, monkeypatch):
    seeded(spark, place).close()
    with open_table(spark, place[0], place[1]("b")) as r:
        r.load_items()
    from keyloom.sources.store import Store

    real = Store.read

    def far(self, name):
        if name == "HEAD.json":
            raise ConnectionError("no route")
        return real(self, name)

    with monkeypatch.context() as m:
        m.setattr(Store, "read", far)
        with open_table(spark, place[0], place[1]("b"), offline="auto") as r:
            assert r.offline and len(dict(r.items())) == 3
        with pytest.raises(ConnectionError):
            open_table(spark, place[0], place[1]("b"))
    with open(place[0].removeprefix("file://") + "/HEAD.json", "w") as f:
        f.write("{damaged")
    (crc := pathlib.Path(place[0].removeprefix("file://")) / ".HEAD.json.crc").unlink(missing_ok=True)
    assert not crc.exists()
    with pytest.raises(ValueError):
        open_table(spark, place[0], place[1]("b"), offline="auto")


def test_catalogue_is_a_mapping(spark, place):
    t = seeded(spark, place)
    t.set_metadata({"title": "x"})
    t.changes().push()
    with open_catalog(spark, place[0] + "-cat", place[1]("cat"), "n") as c:
        c["one"] = place[0]
        c.set("two", Connection(place[0]))
        assert "one" in c and "none" not in c and 3 not in c and set(c) == {"one", "two"} and len(c) == 2
        assert c["one"]["timestamp"] == t.head.ts and json.loads(c["one"]["remote_meta"]) == {"title": "x"}
        del c["one"]
        assert list(c) == ["two"] and c.get("one") is None
        for key, error in ((5, TypeError), ("a b", ValueError)):
            with pytest.raises(error):
                c.add(place[0], key)
        with pytest.raises(MissingTableError):
            c["none"] = place[0] + "-nothing"
        assert c.changes().push()
    t.close()
    with open_catalog(spark, place[0] + "-cat", place[1]("cat2")) as c:
        assert dict(c.items())["two"]["type"] == "table"
        with pytest.raises(ReadOnlyError):
            c["x"] = place[0]


def test_sessions(spark, place):
    s = Session(spark, place[0])
    assert not s.initialized and s.get_uuid() is None and s.get_type() is None and s.get_timestamp() is None and s.get_user_metadata() is None
    t = seeded(spark, place)
    assert s.initialized and s.get_uuid().hex == t.head.uuid and s.get_type() == "table" and s.get_timestamp() == t.head.ts == t.session.get_timestamp()
    assert s.writable() and {"path", "bytes", "modified"} == set(s.list_objects().columns) and s.list_objects().where("path = 'HEAD.json' and bytes > 0").count() == 1
    assert {(x.gid, x.gen) for x in s.list_object_versions().where("live").collect()} == set(t.head.manifest.items())
    s.put_object("note.json", {"a": 1})
    assert t.store.read("note.json") == {"a": 1} and s.delete_object("note.json") is None and not t.store.exists("note.json")
    for name in ("", "/x", "../x"):
        with pytest.raises(ValueError):
            s.delete_object(name)
    t.close()
    with pytest.warns(UserWarning, match="clear"):
        far = Connection.of("http://host/table")
    with pytest.raises(ReadOnlyError):
        open_table(spark, far, place[1]("h"), "w")
    for bad, error in (("", ValueError), ({"path": " "}, ValueError), ({"path": "/x", "options": {1: 2}}, TypeError)):
        with pytest.raises(error):
            Connection.of(bad)


def test_old_locks_are_broken_once(spark, place, monkeypatch):
    from keyloom.sources import store as module

    t = seeded(spark, place)
    old = t._lock
    monkeypatch.setattr(module, "LOCK_AGE", -1)
    one = module.Lock(t.store, 1)
    with pytest.raises(LockLostError):
        old.verify()
    one.verify()
    assert [x for x, _ in one.store.list() if x.startswith("broken")] == []
    t._lock = one
    t.close()


def test_compaction_during_a_push_is_told(spark, place, monkeypatch):
    t = seeded(spark, place)
    t["k1"] = b"new"
    with pytest.raises(PushInProgressError):
        t._pushing = True
        t.prune()
    t._pushing = False
    real = t.store.list

    def compacts(name=""):
        if name.startswith("groups/gen="):
            t.state["segments"] = []
        return real(name)

    before, held = t.store.read("HEAD.json"), t.state
    t._flush()
    segments = list(held["segments"])
    monkeypatch.setattr(t.store, "list", compacts)
    with pytest.raises(CompactionError):
        t.changes().push()
    monkeypatch.undo()
    t.state["segments"] = segments
    assert t.store.read("HEAD.json") == before and t.changes().push()
    t.close()


def test_restamping_warns_and_changes_are_in_utc(spark, place):
    t = seeded(spark, place)
    t.set("k1", b"late", OLD)
    t.set("new", b"x", OLD)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    change = {x["key"]: x for x in t.changes().iter_changes()}
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert change["new"]["local_timestamp"] == dt.datetime(2001, 9, 9, 1, 46, 40, tzinfo=dt.UTC) and change["new"]["remote_timestamp"] is None
    with pytest.warns(UserWarning, match="1 pending writes are not newer"):
        assert t.changes().push()
    t.close()


def test_plans(spark, place, monkeypatch):
    from keyloom.operators import table as module

    monkeypatch.setattr(module, "FILE_BYTES", 64)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    t = seeded(spark, place, None, 40)
    files = [x for x, _, _ in t.store.files("groups") if x.endswith(".parquet")]
    assert len(files) > 1, "a large group is spread over files"
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    monkeypatch.undo()
    t["k1"] = b"new"
    text = lambda df: df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    plan = text(t.to_df().where("key = 'k7'"))
    scans = [x for x in plan.split("\n(") if "Scan parquet" in x.split("\n")[0]]
    # Rows of the store, local records of either arm and the index beside them; the index that tells stale copies is read by key alone.
    assert len(scans) == 5 and sum("EqualTo(key,k7)" in x for x in scans) == 4, "conditions on keys reach the scans of both arms"
    assert all("value" not in x.split("ReadSchema")[1] for x in scans if "EqualTo(key,k7)" not in x) and "FullOuter" not in plan
    t.close()
    t = open_table(spark, place[0] + "2", place[1]("p"), "n", num_groups=5)
    t.update({f"k{i}": b"v" for i in range(40)})
    t.changes().push()
    assert len(t.committed([3]).inputFiles()) == 1 and len(t.committed().inputFiles()) == 5
    assert "PartitionFilters: [isnotnull(gid" in text(t.committed().where("gid = 3"))
    t.close()


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_upsert_computes_its_frame_once(spark, place):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for x in batches:
            seen.add(x.num_rows)
            yield x

    t = open_table(spark, place[0], place[1]("a"), "n")
    t.upsert(spark.range(20).selectExpr("cast(id as string) key", "'v' value").mapInArrow(count, "key string, value string"))
    assert seen.value == 20 and len(t) == 20
    for bad in ("if(id = 3, null, 'v')", "if(id = 3, cast(null as string), 'v')"):
        with pytest.raises(ValueError):
            # Of the repeated key the row that is in order is the greater one.
            t.upsert(spark.range(6).selectExpr("cast(id % 3 as string) key", f"{bad} value"))
    assert len(t) == 20 and len(t.local.list("rows")) == 1
    t.close()


def test_nothing_committed_is_not_joined(spark, place):
    t = open_table(spark, place[0], place[1]("a"), "n")
    t.upsert(spark.range(5).selectExpr("cast(id as string) key", "'v' value"))
    assert "Join" not in _optimized(t.to_df()) and t.to_df().count() == 5
    t.close()


def test_load_items_tells_what_stays_stale(spark, place):
    t = seeded(spark, place, None)
    r = open_table(spark, place[0], place[1]("r"))
    assert r.load_items() == {}
    t["k2"] = b"newer"
    assert t.changes().push()
    path = t.store.path(f"index/{t.head.commit}")
    cut = spark.createDataFrame([(x.key, x.ts, x.gid, x.length + (x.key == "k2")) for x in t.index().collect()], "key string, ts long, gid int, length long")
    cut.write.mode("overwrite").parquet(path)
    r.pull()
    assert r.load_items() == {"k2": "in the index and not whole in its group"}
    t.close()


def test_sizes_of_a_push_are_those_of_its_groups(spark, place):
    from keyloom.operators import views

    t = seeded(spark, place, 5, 30)
    t.update({"k1": b"longer", "k31": b"n"})
    t.remove(spark.createDataFrame([("k2",), ("k3",), ("none",)], "key string"))
    changes = views.local_changes(t._segments(), t.index(), 1, t._gid())
    told = {x.gid: (x.bytes, x.n) for x in views.packed_sizes(t.index(), changes.where("due")).collect()}
    assert t.changes().push()
    held = {x.gid: (x.bytes, x.n) for x in views.group_sizes(t.committed().select("key", "value"), 5).collect()}
    assert told and told == {g: held.get(g, (0, 0)) for g in told}
    t.clear()
    changes = views.local_changes(t._segments(), t.index(), 1, t._gid())
    assert {(x.bytes, x.n) for x in views.packed_sizes(t.index(), changes.where("due")).collect()} == {(0, 0)}
    t.close()


def test_ops_are_those_of_the_last_records(spark, place):
    t = seeded(spark, place, 5)
    t["k1"] = b"w"
    t["k4"] = b"w"
    t.sync()
    t.remove(spark.createDataFrame([("k1",), ("k2",), ("k4",)], "key string"))
    t["k2"] = b"again"
    assert len(t.state["segments"]) > 1
    want = {"k1": "D", "k2": "W", "k3": "C"}
    assert {x.key: x.op for x in t._ops().collect()} == want == {x.key: x.op for x in t._segments().collect()}
    assert "SortAggregate" not in t._ops()._jdf.queryExecution().executedPlan().toString(), "numbers are aggregated by hash"
    t.close()
