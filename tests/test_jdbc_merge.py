"""Merge texts per engine; those that DuckDB understands are run there, inside the test's process."""

import duckdb
import pytest

from tablehaul.sources import jdbc_merge as merging

COLUMNS = ["id", "part", "name", "seen", "note"]
KEYS = ["id", "part"]


def text(engine, **more):
    return merging.merge_statement(engine, "shop.orders", "shop.stage", COLUMNS, KEYS, **more)


def test_names_are_quoted_per_engine():
    assert merging.quote_name("mysql", "a`b") == "`a``b`"
    assert merging.quote_name("postgres", 'a"b') == '"a""b"'
    assert merging.quote_name("sqlserver", "a]b[") == "[a]]b[]"
    assert merging.quote_name("Snowflake", "A b") == '"A b"'
    assert merging.qualified("mysql", "shop.orders") == "`shop`.`orders`"
    assert merging.qualified("postgresql", ["we.ird", "t"]) == '"we.ird"."t"'
    long = merging.staging_name("s." + "t" * 100)
    assert long[0] == "s" and len(long[1]) <= 63 and long != merging.staging_name("s." + "t" * 100)
    with pytest.raises(ValueError, match="Unsupported"):
        merging.quote_name("oracle", "a")


def test_mysql_text():
    assert text("mysql", fill=["seen"], keep=["note"]) == (
        "INSERT INTO `shop`.`orders` (`id`, `part`, `name`, `seen`, `note`) "
        "SELECT src.`id`, src.`part`, src.`name`, src.`seen`, src.`note` FROM `shop`.`stage` AS src "
        "ON DUPLICATE KEY UPDATE `shop`.`orders`.`name` = src.`name`, `shop`.`orders`.`seen` = COALESCE(src.`seen`, `shop`.`orders`.`seen`)"
    )
    assert text("mysql", mode="skip_existing").endswith("ON DUPLICATE KEY UPDATE `shop`.`orders`.`id` = `shop`.`orders`.`id`")


def test_postgres_text():
    assert text("postgresql", fill=["seen"], keep=["note"]) == (
        'INSERT INTO "shop"."orders" AS tgt ("id", "part", "name", "seen", "note") '
        'SELECT src."id", src."part", src."name", src."seen", src."note" FROM "shop"."stage" AS src '
        'ON CONFLICT ("id", "part") DO UPDATE SET "name" = EXCLUDED."name", "seen" = COALESCE(EXCLUDED."seen", tgt."seen")'
    )
    assert text("postgresql", mode="skip_existing").endswith('ON CONFLICT ("id", "part") DO NOTHING')


def test_sql_server_and_snowflake_texts():
    assert text("sqlserver", fill=["seen"], keep=["note"]) == (
        "MERGE INTO [shop].[orders] WITH (HOLDLOCK) AS tgt USING [shop].[stage] AS src ON tgt.[id] = src.[id] AND tgt.[part] = src.[part] "
        "WHEN MATCHED THEN UPDATE SET [name] = src.[name], [seen] = COALESCE(src.[seen], tgt.[seen]) "
        "WHEN NOT MATCHED THEN INSERT ([id], [part], [name], [seen], [note]) VALUES (src.[id], src.[part], src.[name], src.[seen], src.[note]);"
    )
    skip = text("snowflake", mode="skip_existing")
    assert "WHEN MATCHED" not in skip and "HOLDLOCK" not in skip and not skip.endswith(";")


def test_only_keys_and_bad_calls():
    for engine in ("mysql", "postgres", "sqlserver", "snowflake"):
        only = merging.merge_statement(engine, "t", "s", ["id"], ["id"])
        assert "COALESCE" not in only and "SET  " not in only
    with pytest.raises(ValueError, match="keys"):
        merging.merge_statement("mysql", "t", "s", ["a"], [])
    with pytest.raises(ValueError, match="keys"):
        merging.merge_statement("mysql", "t", "s", ["a"], ["b"])
    with pytest.raises(ValueError, match="mode"):
        text("mysql", mode="other")


class Duck:
    """The calls of a connection on an in-memory database."""

    def __init__(self):
        self.con, self.ended = duckdb.connect(), []
        self.con.execute('CREATE SCHEMA shop; CREATE TABLE shop.orders (id INT, part INT, name VARCHAR, seen INT, note VARCHAR, UNIQUE (id, part))')
        self.con.execute("INSERT INTO shop.orders VALUES (1, 1, 'one', 10, 'first'), (2, 1, 'two', 20, 'first'), (NULL, 1, 'none', 0, 'first')")
        self.con.execute("CREATE TABLE shop.stage AS SELECT * FROM (VALUES (1, 1, 'ONE', NULL::INT, 'new'), (3, 1, 'three', 30, 'new'), (NULL, 1, 'nobody', 1, 'new'), (4, NULL, 'half', 4, 'new')) t(id, part, name, seen, note)")
        self.con.execute("BEGIN")

    def run(self, sql):
        self.con.execute(sql)
        return 0

    def number(self, sql):
        return self.con.execute(sql).fetchone()[0]

    def commit(self):
        self.ended.append("commit")
        self.con.execute("COMMIT")
        self.con.execute("BEGIN")

    def rollback(self):
        self.ended.append("rollback")
        self.con.execute("ROLLBACK")
        self.con.execute("BEGIN")

    def rows(self):
        return sorted(self.con.execute("SELECT * FROM shop.orders").fetchall(), key=repr)

    def tables(self):
        return {r[0] for r in self.con.execute("SELECT table_name FROM information_schema.tables").fetchall()}


STAGED = [(3, 1, "three", 30, "new"), (None, 1, "nobody", 1, "new"), (4, None, "half", 4, "new")]
STORED = [(2, 1, "two", 20, "first"), (None, 1, "none", 0, "first")]


@pytest.mark.parametrize("engine", ["postgresql", "snowflake"])
def test_merges_run(engine):
    for more, first in (
        ({}, (1, 1, "ONE", None, "new")),
        ({"fill": ["seen"], "keep": ["note"]}, (1, 1, "ONE", 10, "first")),
        ({"mode": "skip_existing"}, (1, 1, "one", 10, "first")),
    ):
        duck = Duck()
        merging.apply_merge(duck, engine, "shop.orders", "shop.stage", COLUMNS, KEYS, 4, **more)
        assert duck.rows() == sorted([first, *STORED, *STAGED], key=repr)
        assert duck.tables() == {"orders"}


def test_incomplete_staging_and_failures_change_nothing():
    duck = Duck()
    before = duck.rows()
    with pytest.raises(RuntimeError, match="4 rows are staged for 3"):
        merging.apply_merge(duck, "postgresql", "shop.orders", "shop.stage", COLUMNS, KEYS, 3)
    assert duck.rows() == before and duck.tables() == {"orders"} and duck.ended == ["rollback", "commit"]
    duck = Duck()
    with pytest.raises(duckdb.Error):
        merging.apply_merge(duck, "postgresql", "shop.orders", "shop.stage", [*COLUMNS, "nowhere"], KEYS, 4)
    assert duck.rows() == before and duck.tables() == {"orders"}


def test_one_row_per_key_is_staged(spark, rows):
    df = spark.createDataFrame([(1, "a", None, 1), (1, "b", 5, 2), (2, "c", 7, 1), (None, "d", 1, 1), (None, "d", 1, 1)], "id int, name string, seen int, _order_0 int")
    order = ["_order_0"]
    assert rows(merging.one_row_per_key(df, ["id"], "upsert", order)) == [(1, "b", 5), (2, "c", 7), (None, "d", 1), (None, "d", 1)]
    assert rows(merging.one_row_per_key(df, ["id"], "skip_existing", order))[0] == (1, "a", None)
    folded = rows(merging.one_row_per_key(df, ["id"], "upsert", order, fill=["seen"], keep=["name"]))
    assert folded[0] == (1, "a", 5)
    with pytest.raises(Exception, match="repeats"):
        merging.one_row_per_key(df.drop("_order_0"), ["id"], "upsert", None).collect()
