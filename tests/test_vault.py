"""The vault, pack files, aliases, scanners and members of TypeScript classes."""

import json
import os
import stat

import pytest

from lodeline.operators import discovery, iterate, ranking, resolve
from lodeline.plans import commands
from lodeline.plans.fixtures import graph
from lodeline.sources import parse, vault


@pytest.fixture
def root(tmp_path):
    files = {
        "web/tsconfig.json": '{\n // aliases\n "compilerOptions": {"paths": {"@app/*": ["./src/*"], "@": ["index"],},}}', "web/src/util.ts": "export function help(a: string): number { return 1 }\n",
        "web/main.ts": 'import {help} from "@app/util";\nexport class A { run(): number { return help("x") } }\n', "requirements.txt": "pytest\nfastapi\n", "blob.bin": "\0\1\2" * 400,
    }
    for k, v in files.items():
        (tmp_path / k).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / k).write_text(v)
    (tmp_path / "wide.py").write_bytes("def wide():\n    return 'ü'\n".encode("utf-16"))
    return str(tmp_path)


def test_learning_twice_saves_once(spark, root):
    learnt = commands.learn_into_vault(spark, root)
    names = {(r.category, r.name) for r in learnt.collect()}
    assert ("testing", "pytest") in names
    assert commands.learn_into_vault(spark, root).count() == 0
    rows = commands.remembered(spark, root).collect()
    assert {(r.category, r.name) for r in rows} == names and rows == sorted(rows, key=lambda r: (r.category, -r.confidence, r.id))
    assert os.path.exists(os.path.join(root, vault.NAME + ".bak")) and not os.path.exists(os.path.join(root, vault.NAME + ".lock"))


def test_vaults_that_are_not_as_they_should_be(spark, tmp_path):
    path = tmp_path / vault.NAME
    assert vault.load(spark, str(tmp_path)).count() == 0
    path.parent.mkdir()
    path.write_text(" ")
    assert vault.load(spark, str(tmp_path)).count() == 0
    path.write_text("[1]")
    with pytest.warns(UserWarning):
        assert vault.load(spark, str(tmp_path)).count() == 0
    for bad in ("{", json.dumps({"rules": [{"id": "1"}]}), json.dumps({"rules": [{"id": "1", "category": "c", "rule": "r", "confidence": "high"}]})):
        path.write_text(bad)
        with pytest.raises(vault.VaultError):
            vault.load(spark, str(tmp_path))
    with vault.held(str(tmp_path)), pytest.raises(vault.VaultError), vault.held(str(tmp_path), 0.2):
        pass


def test_imports_by_alias(spark, root):
    files = commands.scan(spark, root)
    assert [tuple(r) for r in commands.aliases(files).orderBy("ordinal").collect()] == [("@app/", "web/src/", 0), ("@", "web/index", 1)]
    g = commands.assembled(files)
    path = {r.id: r.path for r in g.nodes.collect()}
    assert {(path[r.src], path[r.dst]) for r in g.of_type(("IMPORTS",)).collect()} == {("web/main.ts", "web/src/util.ts")}
    i = spark.createDataFrame([("a/b.ts", "./c"), ("a/b.ts", "@x/y"), ("a/b.ts", "react")], "src string, module string")
    a = spark.createDataFrame([("@", "one/", 1), ("@x/", "two/", 0)], "prefix string, target string, ordinal int")
    assert {(r.module) for r in resolve.aliased(i, a).collect()} == {"a/c", "two/y", "react"}


def test_packs_are_files_of_their_own(spark, root):
    packed, left_out = commands.pack(spark, root, raw=True)
    assert {r.path for r in left_out.collect()} == {"blob.bin"}
    one, two = (commands.write_pack(packed, root, "../mine") for _ in range(2))
    assert one != two and os.path.dirname(one) == os.path.join(root, ".lodeline", "packs") and stat.S_IMODE(os.stat(one).st_mode) == 0o600
    text = open(one, encoding="utf-8").read()
    assert text.startswith("Context of mine\n") and "return 'ü'" in text and "## web/main.ts\n" in text and not any(x.endswith(".new") for x in os.listdir(os.path.dirname(one)))
    packed, left_out = commands.pack(spark, root, raw=True, max_tokens=60)
    assert sum(len(r.text) for r in packed.collect()) <= 60 * 3.5 and left_out.count() > 1


def test_scanners_are_passed_what_came_before(spark, root, monkeypatch):
    monkeypatch.setitem(commands.SCANNERS, "own", lambda files, g, domains, found: found["dependencies"].where("name = 'pytest'"))
    files = commands.scan(spark, root)
    g = commands.assembled(files)
    none = spark.createDataFrame([], "id string, name string, n int, members string")
    found = commands.scanned(files, g, none)
    assert list(found)[-1] == "own" and found["own"].count() == 1 and found["frameworks"].first().framework == "FastAPI"


def test_impact_of_nothing(spark):
    g = graph(spark, "/root/testdata/sf0.001")
    assert iterate.impact(g, "no/such/file").count() == 0
    with pytest.raises(iterate.NoMatch):
        iterate.impact(g, "no/such/file", strict=True)


def test_typescript_members():
    text = """
export class Foo<T> extends Bar<T> implements Baz {
  private readonly name: string = "x;y";
  items: Map<string, number>;
  constructor(private http: Client, public n = 3) { super(); }
  async load(id: string, opts: {a: number; b?: string}): Promise<void> {
    if (id) { call(id); }
  }
  get value(): number { return 1; }
}
interface P { a: string; b?: number; run(x: number): void; nested: { c: string; d: number }; last: boolean }
"""
    foo, p = parse.parse_typescript("a.ts", text)["entities"]
    assert [(f["name"], f["type"], f["default"]) for f in foo["fields"]] == [("name", "string", '"x;y"'), ("items", "Map<string, number>", None)]
    assert [(m["name"], [(i["name"], i["type"], i["default"]) for i in m["inputs"]], m["returns"]) for m in foo["methods"]] == [
        ("constructor", [("http", "Client", None), ("n", None, "3")], None), ("load", [("id", "string", None), ("opts", "{a: number, b?: string}", None)], "Promise<void>"), ("value", [], "number"),
    ]
    assert [f["name"] for f in p["fields"]] == ["a", "b", "nested", "last"] and [m["name"] for m in p["methods"]] == ["run"]


def test_guessed_charsets_must_read_like_text():
    assert parse.decoded("grüße, señor".encode("cp1252")) == "grüße, señor" and parse.decoded("hi there ".encode("utf-16-le") * 9) == "hi there " * 9
    assert parse.decoded(bytes(range(128, 256)) * 10) is None and parse.decoded(b"\1\2\3\x81" * 300) is None


def test_fingerprint_tells_nulls_and_order_apart(spark):
    def of(rows, **kw):
        return discovery.fingerprint(spark.createDataFrame(rows, "path string, size long, mtime string"), **kw).first().fingerprint

    rows = [(f"p{i}", i, "t") for i in range(600)]
    assert of(rows) == of(rows[::-1]) != of(rows[1:])
    assert len({of([("a", None, "1")]), of([("a", 1, None)]), of([("a", None, None)]), of([(None, 1, "a")]), of([])}) == 5
    assert of(rows, depth=1) != of(rows, depth=2)


def test_budget_over_many_ranges(spark):
    import random

    rng = random.Random(4)
    rows = [(i, rng.choice([1.0, 5.0, 50.0, 400.0])) for i in range(500)] + [(1000, None)]
    for cap in (0.0, 60.0, 3000.0, 1e9):
        total, want = 2.0, []
        for i, s in rows[:-1]:
            if total + s <= cap:
                total += s
                want.append(i)
        d = spark.createDataFrame(rows, "id long, size double").repartition(7)
        assert sorted(r.id for r in ranking.within_budget(d, cap, d.id, spent=2.0).collect()) == want
