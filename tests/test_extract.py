"""Scanners on inline sources, and an index of a small mixed project."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.extract import index, java, scripts, sql

ORDER = """package com.shop.order;
import com.shop.stock.Stock;
import org.acme.util.Clock;
@Service
public class OrderService extends Base implements Placing {
    private final Stock stock;
    private final Clock clock = null;
    // if (x) { not a brace
    public OrderService(Stock stock) { this.stock = stock; }
    public Order place(String name, java.util.List<String> lines) {
        String text = "} select * from orders where";
        stock.take(name, 1);
        check();
        stock.level().refill();
        return new Order(name);
    }
    private void check() { helper(1); }
    static class Inner { void go() { } }
    public static void main(String[] args) { }
}
"""
STOCK = """package com.shop.stock;
public class Stock {
    public void take(String n, int k) { }
    public void take(String n) { }
    public Level level() { return null; }
}
"""
LEVEL = "package com.shop.stock;\npublic class Level { public void refill() { } }\n"
BASE = "package com.shop.order;\npublic class Base { protected void helper(int x) { } public void check() { } }\n"
PLACING = "package com.shop.order;\npublic interface Placing { Order place(String n, java.util.List<String> l); }\n"
RECORD = "package com.shop.order;\npublic record Order(String name) { }\n"
MIGRATIONS = [
    ("db/V1__a.sql", "create table customer (id int); create table orders (id int, c int references customer(id)); -- drop table orders;\n"),
    ("db/V2__b.sql", "alter table customer rename to client; create view recent as select * from orders; drop table if exists nothing;"),
    ("db/V10__c.sql", "create or replace view recent as select * from client; create function f() returns int as $$ begin; drop table orders; end $$;"),
]
PY = '''import os
from .helper import load
class Tool(Base):
    """def not_this(): pass"""
    def run(self):
        self.step()
        load("x")
        def inner():
            pass
    def step(self): return "select * from orders"
class Base: pass
async def main():
    Tool()
    run_all()
def run_all(): pass
'''
SH = """#!/bin/bash
source ./lib.sh
build() {
  docker build .   # git push
  cat <<EOF
git pull
EOF
}
function ship { build; kubectl apply; }
ship
"""
TS = """@Injectable()
export class WorkerService {
  constructor(private http: HttpClient) {}
  api = '/orders';
  load(id: string, opts: { a: number }) { return this.get(id); }
  get(id: string) { return this.http.get(`${this.api}/${id}`); }
}
export interface Worker { id: string }
export enum State { A }
"""
COMPONENT = "@Component({})\nexport class ListComponent {\n  svc = inject(WorkerService);\n  show() { this.svc.get('1'); }\n}\n"
DART = "class CartService extends Base with Logging {\n  final Api api;\n  void add(String id) { remove(id); api.send(id); }\n  void remove(String id) {}\n}\nclass _Hidden {}\nenum Kind { a }\n"


def ids(rows, kind="node"):
    return {r["id"]: r["type"] for r in rows if r["kind"] == kind}


def test_java_rows():
    rows = java.extract("OrderService.java", ORDER, "CRUD")
    assert ids(rows) == {"com.shop.order.OrderService": "SERVICE", "com.shop.order.OrderService.Inner": "CLASS"}
    o = "com.shop.order.OrderService#"
    assert set(ids(rows, "method")) == {o + "<init>(Stock)", o + "place(String,List)", o + "check()", o + "main(String)", "com.shop.order.OrderService.Inner#go()"}
    assert [r["id"] for r in rows if r["kind"] == "entry"] == ["com.shop.order.OrderService"]
    refs = {(r["type"], r["target"]) for r in rows if r["kind"] == "ref"}
    assert {("INJECTS", "Stock"), ("EXTENDS", "Base"), ("IMPLEMENTS", "Placing"), ("RETURNS_TYPE", "Order"), ("CALLS_METHOD", "Stock"), ("CALLS_METHOD", "Order")} <= refs
    assert ("table_ref", "orders") in {(r["kind"], r["target"]) for r in rows}


def test_java_shape_ignores_bodies():
    a = java.shape_lines(java.extract("a", ORDER))
    assert a == java.shape_lines(java.extract("a", ORDER.replace("stock.take(name, 1);", "")))
    assert a != java.shape_lines(java.extract("a", ORDER.replace("check()", "verify()")))


@pytest.mark.parametrize(
    "source,tier,want",
    [
        ("class A extends AggregateRoot {}", "DDD", "AGGREGATE"),
        ("class A implements CommandHandler<X> {}", "DDD", "COMMAND_HANDLER"),
        ("record A(int x) implements Query {}", "DDD", "QUERY"),
        ("@RestController class A {}", "CRUD", "CONTROLLER"),
        ('@Entity @Table(name = "a_view") class A {}', "CRUD", "VIEW"),
        ("@Entity class A {}", "CRUD", "ENTITY"),
        ("@RestController class A {}", "GENERIC", "CLASS"),
        ("class UserRepository {}", "GENERIC", "REPOSITORY"),
        ("interface A {}", "GENERIC", "INTERFACE"),
        ("enum A { X }", "GENERIC", "ENUM"),
    ],
)
def test_classification(source, tier, want):
    assert list(ids(java.extract("A.java", source, tier)).values()) == [want]


def test_sql_fold():
    rows = sql.fold(MIGRATIONS[::-1])
    assert ids(rows) == {"sql:client": "SQL_TABLE", "sql:orders": "SQL_TABLE", "sql:recent": "SQL_VIEW", "sql:f": "SQL_ROUTINE"}
    assert {(r["source_id"], r["type"], r["target"]) for r in rows if r["kind"] == "edge"} == {("sql:orders", "REFERENCES_FK", "sql:client"), ("sql:recent", "DERIVES_FROM", "sql:client")}


def test_migrations_are_folded_apart(spark):
    """Random migrations with renamings that cross names; the rows are those of the fold in one go, and are not made by one task."""
    chance, names = random.Random(3), [f"t{n}" for n in range(30)]
    files = []
    for n in range(150):
        a, b = chance.choice(names), chance.choice(names)
        kinds = [f"create table {a} (id int, x int references {b}(id));", f"create view {a} as select * from {b};", f"alter table {a} rename to {b};", f"alter table {a} add foreign key (x) references {b};", f"drop table {a}, {b} cascade;"]
        files.append((f"db/V{n // 7}.{n % 7}__x.sql", "sql", "-- " + "\n".join(chance.choices(kinds, [6, 2, 1, 2, 1], k=2)) + "\n" + chance.choices(kinds, [6, 2, 1, 2, 1])[0]))
    files += [(f"db/V{n}__y.sql", "sql", f"create table y{n} (id int references y{n // 2});") for n in range(40)]
    table = spark.createDataFrame(files, "file_path string, language string, content string").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = index.extract_rows(table, "GENERIC").withColumn("_task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sql.fold([(p, t) for p, _, t in files])
    fields = ["kind", "file_path", "id", "type", "name", "line", "snippet", "source_id", "target"]
    assert sorted(map(str, ([r[f] for f in fields] for r in got))) == sorted(map(str, ([r[f] for f in fields] for r in want)))
    assert len({r["_task"] for r in got if r["kind"] == "node"}) > 1


def test_python_rows():
    rows = scripts.python("pkg/tool.py", PY)
    assert ids(rows) == {"pkg/tool.py": "PY_MODULE", "pkg/tool.py::Tool": "PY_CLASS", "pkg/tool.py::Base": "PY_CLASS"}
    assert set(ids(rows, "method")) == {"pkg/tool.py::Tool#run()", "pkg/tool.py::Tool#step()", "pkg/tool.py#main()", "pkg/tool.py#run_all()"}
    assert ("pkg/tool.py::Tool#run()", "pkg/tool.py::Tool#step()") in {(r["source_id"], r["target"]) for r in rows if r["kind"] == "py_call"}
    assert "pkg/helper" in {r["target"] for r in rows if r["kind"] == "py_import"}


def test_shell_rows():
    rows = scripts.shell("ci/run.sh", SH)
    edges = {(r["source_id"], r["type"], r["target"]) for r in rows if r["kind"] == "edge"}
    assert edges == {("ci/run.sh#build()", "RUNS", "docker"), ("ci/run.sh#ship()", "CALLS", "ci/run.sh#build()"), ("ci/run.sh#ship()", "RUNS", "kubectl"), ("ci/run.sh", "CALLS", "ci/run.sh#ship()")}
    assert [r["target"] for r in rows if r["kind"] == "sources"] == ["ci/lib.sh"]


def test_typescript_dart_groovy():
    ts = scripts.typescript("w.ts", TS)
    assert ids(ts) == {"WorkerService": "FE_SERVICE", "Worker": "FE_MODEL", "State": "FE_ENUM"}
    assert set(ids(ts, "method")) == {"WorkerService#load(string,object)", "WorkerService#get(string)"}
    dart = scripts.dart("c.dart", DART)
    assert ids(dart) == {"CartService": "FE_MODEL", "Kind": "FE_ENUM"}
    assert set(ids(dart, "method")) == {"CartService#add(String)", "CartService#remove(String)"}
    assert ids(scripts.groovy("x/Deploy.groovy", "println 'class No'")) == {"Deploy": "GROOVY_SCRIPT"}
    assert ids(scripts.groovy("x/D.groovy", "class A {}\nclass B {}")) == {"A": "GROOVY_SCRIPT", "B": "GROOVY_SCRIPT"}


def test_index_of_a_project(spark):
    sources = [
        ("src/OrderService.java", "java", ORDER), ("src/Stock.java", "java", STOCK), ("src/Level.java", "java", LEVEL), ("src/Base.java", "java", BASE), ("src/Placing.java", "java", PLACING),
        ("src/Order.java", "java", RECORD), ("pkg/tool.py", "python", PY), ("pkg/helper.py", "python", "def load(x): pass\n"), ("ci/run.sh", "shell", SH), ("ci/lib.sh", "shell", "x=1\n"),
        ("w.ts", "typescript", TS), ("l.ts", "typescript", COMPONENT), ("OrdersController.java", "java", "@RestController public class OrdersController { }"), *((p, "sql", t) for p, t in MIGRATIONS),
    ]
    files = spark.createDataFrame([(p, l, t, 1) for p, l, t in sources], "file_path string, language string, content string, last_modified bigint")
    deps = spark.createDataFrame([(0, "org.acme", "util"), (1, "org", "other")], "ord int, group_id string, artifact string")
    out = index.build(files, deps)
    nodes = {r.id: r.type for r in out["nodes"].collect()}
    edges = {(r.type, r.source_id, r.target_id) for r in out["edges"].collect()}
    o, s = "com.shop.order.OrderService", "com.shop.stock.Stock"
    for e in (
        ("CALLS", f"{o}#place(String,List)", f"{s}#take(String,int)"), ("CALLS", f"{o}#place(String,List)", f"{o}#check()"), ("CALLS", f"{o}#check()", "com.shop.order.Base#helper(int)"),
        ("CALLS", f"{o}#place(String,List)", "com.shop.stock.Level#refill()"), ("OVERRIDES", f"{o}#check()", "com.shop.order.Base#check()"), ("OVERRIDES", f"{o}#place(String,List)", "com.shop.order.Placing#place(String,List)"),
        ("INJECTS", o, s), ("RETURNS_TYPE", o, "com.shop.order.Order"), ("USES_LIBRARY", o, "org.acme.util.Clock"), ("REFERENCES_TABLE", o, "sql:orders"), ("IMPORTS", "pkg/tool.py", "pkg/helper.py"),
        ("CALLS", "pkg/tool.py::Tool#run()", "pkg/helper.py#load()"), ("EXTENDS", "pkg/tool.py::Tool", "pkg/tool.py::Base"), ("SOURCES", "ci/run.sh", "ci/lib.sh"), ("RUNS", "ci/run.sh#build()", "docker"),
        ("USES_SERVICE", "ListComponent", "WorkerService"), ("CALLS_API", "WorkerService", "OrdersController"), ("REFERENCES_FK", "sql:orders", "sql:client"), ("DECLARES_METHOD", s, f"{s}#level()"),
    ):
        assert e in edges, e
    assert ("CALLS", f"{o}#place(String,List)", f"{s}#take(String)") not in edges
    assert nodes["docker"] == "SHELL_COMMAND" and nodes["org.acme.util.Clock"] == "LIBRARY" and nodes[o] == "SERVICE"
    assert {(r.method_id, r.class_id) for r in out["method_return_class"].collect()} >= {(f"{s}#level()", "com.shop.stock.Level")}
    assert out["file_shapes"].count() == 7


def test_shell_programs_and_the_ways_to_draw_in_a_script():
    text = "jq . a.json\nnpx x && pip3 install y | ./gradlew build\ntime scp a b\naws s3 ls\ndocker-compose up\n"
    runs = {r["target"] for r in scripts.shell("x.sh", text) if r["kind"] == "edge" and r["type"] == "RUNS"}
    assert runs == {"jq", "npx", "pip3", "./gradlew", "scp", "docker-compose"}
    text = "source ./a.sh\n. b.sh\nbash c.sh -v\nsh d.sh && ./e.sh\nsource \"$HERE/f.sh\"\n# bash no.sh\necho x.sh\n./e.sh\n"
    drawn = [r["target"] for r in scripts.shell("ci/x.sh", text) if r["kind"] == "sources"]
    assert drawn == [f"ci/{n}.sh" for n in "abcdef"]


def test_dart_types_by_base_and_name():
    text = "".join(f"class {n} {{}}\n" for n in ("A extends Command", "B extends QueryHandler", "C extends StatelessWidget", "OrderStore", "Bus", "CartService", "Api"))
    found = ids(scripts.dart("c.dart", text + "abstract interface class Port {}\n"))
    assert found == {"A": "COMMAND", "B": "QUERY_HANDLER", "C": "FE_COMPONENT", "OrderStore": "FE_SERVICE", "Bus": "FE_SERVICE", "CartService": "FE_MODEL", "Api": "FE_MODEL", "Port": "FE_SERVICE"}


def test_tier_by_its_markers(spark):
    from graphloom.extract import index

    def tier(*texts):
        return index.project_tier(spark.createDataFrame([("A.java", "java", t) for t in texts], "file_path string, language string, content string"))

    assert tier("class A {}", "@Configuration class B {}") == "GENERIC"
    assert tier("class A {}", "@Entity class B {}") == "CRUD"
    assert tier("@Service class A {}", "class B { CommandBus bus; }") == "DDD"
    assert tier("class A implements QueryHandler<Q> {}") == "DDD" and tier("class A extends DomainEvent {}") == "GENERIC"


def test_folders_left_out_by_language(spark):
    from pyspark.sql import functions as F

    from graphloom.sources import files

    paths = {
        "build/A.java": False, "out/A.java": True, "builders/A.java": True, "out/a.sql": False, "target/a.sh": False, "target/a.py": True, "env/a.py": False,
        "env/a.sh": True, "x.egg-info/a.py": False, "navigators/a.py": False, "build/a.ts": True, "node_modules/a.ts": False, "a.g.dart": False, "lib/a.dart": True,
    }
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", files.is_source(F.col("p")).alias("s")).collect()
    assert {r.p: r.s for r in got} == paths


@pytest.mark.parametrize("seed", [1])
def test_a_fast_sync_equals_a_full_index(spark, seed):
    import random

    r = random.Random(seed)
    bodies = ["", "b.go(1);", "b.make().go(2);", "c.end();", "String s = \"select * from orders\";", "Clock k = null; b.go(3); new C();"]

    def project(pick):
        deps = "import org.acme.util.Clock;\n"
        java = [(f"p/U{n}.java", f"package p;\n{deps}class U{n} extends B {{\n  private B b;\n  private C c;\n  void run() {{ {pick[n]} }}\n  void other() {{ {pick[n + 1]} }}\n}}\n") for n in range(0, 8, 2)]
        java += [("p/B.java", "package p;\nclass B { C make() { return null; } void go(int x) { } void other() { } }"), ("p/C.java", "package p;\nclass C { void go(int x) { } void end() { } }")]
        return [(p, "java", t, 1) for p, t in java] + [("db/V1__a.sql", "sql", "create table orders (id int);", 1)]

    before = [r.choice(bodies) for _ in range(8)]
    after = [r.choice(bodies) if n < 4 else b for n, b in enumerate(before)]
    schema = "file_path string, language string, content string, last_modified bigint"
    old, new = (spark.createDataFrame(project(x), schema) for x in (before, after))
    known = spark.createDataFrame([(0, "org.acme", "util")], "ord int, group_id string, artifact string")
    changed = spark.createDataFrame([f for f, g in zip(project(after), project(before)) if f != g], schema)
    fast, full = index.sync_fast(index.build(old, known), changed, "GENERIC", known), index.build(new, known)
    shapes = {r.file_path: r.shape_hash for r in full["file_shapes"].collect()}
    assert shapes == {r.file_path: r.shape_hash for r in fast["file_shapes"].collect()}
    for name in full:
        assert sorted(map(tuple, fast[name].select(*full[name].columns).collect()), key=str) == sorted(map(tuple, full[name].collect()), key=str), name
