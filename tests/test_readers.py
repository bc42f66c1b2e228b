"""Listings and SQLite tables through Spark's data source interface."""

import sqlite3

from pyspark.sql import functions as F

from wrenchlake.sources import readers, tables


def test_listing_in_key_order_with_a_limit(spark, tmp_path):
    names = ["a.txt", "a/b.txt", "a/b/c", "a/b/d", "a-x", "ab/1", "b/2", "b/10", "documents/z", "documents/é", "documents/a/b/c/d", "x"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True) if not (tmp_path / n).exists() else None
        if not (tmp_path / n).exists():
            (tmp_path / n).write_text("x")
    (tmp_path / "empty").mkdir()
    ordered = sorted(names, key=str.encode)
    for prefix in ("", "a", "a/", "a/b", "documents/", "documents/a/b", "nothing", "b/1"):
        for most in (1, 3, 500):
            want = [n for n in ordered if n.startswith(prefix)][:most]
            assert [r.key for r in readers.listed(spark, str(tmp_path), prefix, most).collect()] == want
    assert readers.listed(spark, f"file://{tmp_path}", "a/b/").count() == 2
    assert readers.listed(spark, str(tmp_path / "missing")).count() == 0


def test_a_partition_stops_at_the_limit(tmp_path):
    for i in range(30):
        (tmp_path / f"d{i % 3}").mkdir(exist_ok=True)
        (tmp_path / f"d{i % 3}" / f"{i:02}").write_text("")
    reader = readers.KeyReader({"path": str(tmp_path), "max_keys": "4"})
    parts = reader.partitions()
    assert len(parts) == 3 and [len(list(reader.read(p))) for p in parts] == [4, 4, 4]


VALUES = {"bigint": lambda i: i, "string": lambda i: None if i % 5 == 0 else f"t {i} é", "int": lambda i: i % 7, "boolean": lambda i: [1, 0, None][i % 3], "timestamp_ntz": lambda i: None if i % 4 == 0 else f"2024-01-{i % 28 + 1:02} 10:00:0{i % 10}.{i:06}"}


def test_the_eleven_tables_from_sqlite(spark, tmp_path):
    path = str(tmp_path / "app.db")
    con = sqlite3.connect(path)
    rows = {}
    for name in tables.SCHEMAS:
        fields = [(f.name, f.dataType.simpleString()) for f in tables.schema(name).fields]
        kinds = {"bigint": "INTEGER", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "DATETIME"}
        con.execute(f"CREATE TABLE {name} ({', '.join(f'{c} {kinds[k]}' for c, k in fields)}, extra TEXT)")
        n = 0 if name == "categories" else 97
        rows[name] = [[VALUES[k](i) for _, k in fields] for i in range(1, n + 1)]
        con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * (len(fields) + 1))})", [[*r, "x"] for r in rows[name]])
    con.execute("DELETE FROM users WHERE id BETWEEN 20 AND 60")
    con.commit()
    for name in tables.SCHEMAS:
        df = readers.load_sqlite(spark, path, name)
        assert df.schema == tables.schema(name)
        held = [r for r in rows[name] if name != "users" or not 20 <= r[0] <= 60]
        want = spark.createDataFrame([], df.schema).union(spark.createDataFrame([[x if not isinstance(x, bool) else int(x) for x in r] for r in held], ", ".join(f"{f.name} {'string' if f.dataType.simpleString() == 'timestamp_ntz' else 'bigint' if f.dataType.simpleString() == 'boolean' else f.dataType.simpleString()}" for f in df.schema)).select(*[F.col(f.name).cast(f.dataType) for f in df.schema])) if held else spark.createDataFrame([], df.schema)
        assert sorted(map(str, df.collect())) == sorted(map(str, want.collect())), name


def test_filters_reach_sqlite(spark, tmp_path):
    path = str(tmp_path / "app.db")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE users (id INTEGER PRIMARY KEY, username TEXT, role TEXT)")
    con.executemany("INSERT INTO users VALUES (?, ?, ?)", [(i, f"u{i}", "Manager" if i % 3 == 0 else None) for i in range(1, 200)])
    con.commit()
    df = readers.load_sqlite(spark, path, "users")
    assert df.where("role = 'Manager' AND id > 100").count() == 33
    assert df.where("full_name = 'x'").count() == 0 and df.where("full_name IS NULL").count() == 199
    assert df.where("role IS NULL AND id <= 3").count() == 2
    reader = readers.SqliteReader({"path": path, "table": "users"}, [("id", "bigint")])
    left = list(reader.pushFilters([readers.GreaterThan(("id",), 100), readers.EqualTo(("role",), "Manager"), readers.EqualTo(("is_active",), True)]))
    assert len(left) == 1 and sum(len(list(reader.read(p))) for p in reader.partitions()) == 33
