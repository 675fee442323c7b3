import pytest

from tidemart.plans import guard, isolation

TABLES = {"orders_g", "lines_g"}


@pytest.fixture(scope="module", autouse=True)
def views(spark):
    spark.range(500).selectExpr("id as k", "id % 5 as g").createOrReplaceTempView("orders_g")
    spark.range(300).selectExpr("id as k", "id % 3 as h").createOrReplaceTempView("lines_g")
    spark.range(5).selectExpr("id as k").createOrReplaceTempView("secret_g")
    spark.range(5).selectExpr("id as k").createOrReplaceGlobalTempView("shared_g")


BLOCKED = [
    "delete from orders_g", "update orders_g set k = 1", "insert into orders_g values (1, 2)", "drop table orders_g", "create table x as select * from orders_g", "alter table orders_g rename to y", "truncate table orders_g",
    "select 1; drop table orders_g", "select * from other", "select", "select 1", "select * from text.`/etc/hostname`", "select java_method('java.lang.System', 'getProperty', 'user.dir') from orders_g", "select reflect('java.lang.System', 'getenv', 'HOME') from orders_g",
    "select transform(k) using 'cat' from orders_g", "set spark.sql.ansi.enabled=false", "insert overwrite directory '/tmp/x' select * from orders_g", "execute immediate 'select 1'", "describe orders_g", "explain select * from orders_g", "cache table orders_g",
    "select (select max(input_file_name()) from lines_g) from orders_g", "with a as (select * from other) select * from a", "select * from orders_g where k in (select k from other)", "begin select 1; end", "select * from range(10)", "from orders_g insert into x select k",
    # names of common table expressions hold in their scope alone
    "select * from orders_g where k in (with secret_g as (select 1 as k) select k from secret_g) union all select k, k from secret_g",
    "with a as (with secret_g as (select k from orders_g) select * from secret_g) select a.k from a join secret_g on a.k = secret_g.k",
    "select * from (with secret_g as (select 1 as k) select * from orders_g) x, secret_g", "with secret_g as (select * from secret_g) select o.k from orders_g o join secret_g s on o.k = s.k",
    "select (select max(k) from secret_g) from orders_g", "select k from orders_g, lateral (select * from secret_g)", "select * from orders_g) limit 5 -- ", "select k from orders_g) x, (select k from secret_g",
    "select k from orders_g /* ) */ union select k from global_temp.shared_g", "select current_user from orders_g", "select k, `reflect`('java.lang.System', 'getenv', 'HOME') from orders_g", "select k from orders_g join parquet.`/etc` p", "from orders_g map k using 'cat'",
    "select k from orders_g, text.`/etc/hostname`", "table secret_g", "with orders_g as (select 1 as k) select * from orders_g, secret_g", "select system.builtin.reflect('a', 'b') from orders_g",
]
ALLOWED = [
    "select count(*) from orders_g", "select 'drop table x; delete' as s from orders_g", "with a as (select * from orders_g), b as (select * from a) select count(*) from b", "select k from orders_g union all select k from lines_g",
    "select g, count(*) as n, sum(k) over (order by g) from orders_g group by g, k having count(*) > 0 order by n desc limit 5", "select o.k from orders_g o join lines_g l on o.k = l.k where exists (select 1 from lines_g x where x.k = o.k)",
    "with a (x, y) as (select k, g from orders_g) select x, count(*) as `my count` from a group by x -- the end", "select * from (select k from orders_g) t (n) where n in (1, 2)", "with secret_g as (select k from orders_g) select * from secret_g",
]


@pytest.mark.parametrize("sql", BLOCKED)
def test_blocked(spark, sql):
    with pytest.raises((PermissionError, SyntaxError)):
        guard.guarded(spark, sql, TABLES)


@pytest.mark.parametrize("sql", ALLOWED)
def test_allowed(spark, sql):
    assert len(guard.answer(guard.guarded(spark, sql, TABLES))) <= 200


def test_limit_holds_for_the_whole_union(spark):
    assert len(guard.answer(guard.guarded(spark, "select k from orders_g union all select k from lines_g limit 1000", TABLES, max_rows=7))) == 7


def test_limit_and_names_inside_strings(spark):
    got = guard.answer(guard.guarded(spark, "select 'from secret_g) limit 1' as s, \"global_temp\" as t, k from orders_g where k < 3", TABLES))
    assert len(got) == 3 and got[0].s == "from secret_g) limit 1"


def test_isolated_sessions(spark):
    session = isolation.isolated(spark, {"mine": spark.range(3)})
    assert session.table("mine").count() == 3 and [t.name for t in session.catalog.listTables()] == ["mine"]
    session.range(1).createOrReplaceTempView("theirs")
    assert not spark.catalog.tableExists("theirs") and not [t for t in spark.catalog.listTables("global_temp") if t.name.startswith("v") and len(t.name) == 33]
    open_session = spark.newSession()
    with pytest.raises(isolation.Leak):
        isolation.tried(spark, open_session, set())


def test_budget(spark, folder):
    spark.read.parquet(f"{folder}/lineitem.parquet").createOrReplaceTempView("lines_g")
    with pytest.raises(PermissionError):
        guard.answer(guard.guarded(spark, "select * from lines_g", TABLES), max_bytes=100)


def test_budget_of_a_user(spark):
    asked = guard.guarded(spark, "select count(*) from lines_g", TABLES)
    n = guard.scanned_bytes(asked)
    budget = guard.Budget(max_bytes=3 * n, usual_bytes=n + 1)
    for _ in range(2):
        guard.answer(asked, budget=budget)
    with pytest.raises(PermissionError, match="questions"):
        guard.answer(asked, budget=budget)
    with pytest.raises(PermissionError, match="exceed"):
        guard.Budget(max_bytes=2 * n, usual_bytes=1, spent_bytes=n + 1).spend(n)
    assert guard.Budget().max_bytes // guard.Budget().usual_bytes == 11


def test_timeout(spark):
    spark.range(0, 3_000_000, 1, 4).selectExpr("id as k", "id % 5 as g").createOrReplaceTempView("orders_g")
    with pytest.raises(TimeoutError):
        guard.answer(guard.guarded(spark, "select sum(a.k * b.g) from orders_g a join orders_g b on a.k > b.k", TABLES), seconds=3)
