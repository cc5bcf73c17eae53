from quillgraph.operators import queries as Q
from quillgraph.plans.index import index, update
from quillgraph.sources.store import Store
from quillgraph.sources.tree import list_tree

FILES = {
    "src/base.ts": "export class Base { run() {} }\nexport interface Face {}\n",
    "src/utils.ts": "import { Base } from './base';\nexport function helper() { const b = new Base(); b.run(); }\n",
    "src/app.ts": "import { helper } from './utils';\nimport { gone } from './nowhere';\nimport { of } from 'rxjs';\nexport class App extends Base implements Face { start(): Base { helper(); other(); return null; } }\n",
    "src/inv.cs": "namespace Acme;\npublic interface IInv {}\npublic class Inv : IInv { public Line First { get; set; } }\npublic class Line {}\n",
    "src/use.cs": "using Acme;\nusing System;\npublic class Use { void Go() { var i = new Inv(); } }\n",
    ".gitignore": "dist/\n",
    "dist/x.ts": "class Ignored {}",
    "notes.md": "no source",
} | {f"src/n{i}.ts": f"export function fn{i}() {{ return fn{i + 1}(); }}\n" for i in range(12)}


def write(root, files):
    for p, t in files.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)


def tables(store):
    g = store.graph()
    out = {"symbols": sorted((r["qualified_name"], r["kind"], r["id"]) for r in g.symbols.collect())}
    out["relationships"] = sorted(str((r["source_symbol_id"], r["target_symbol_id"], r["target_external"], r["kind"], r["provenance"], r["confidence"], r["start_line"], r["reason"])) for r in g.relationships.collect())
    out["unresolved"] = sorted(str((r["source_symbol_id"], r["relationship_kind"], r["target_text"])) for r in g.unresolved.collect())
    out["files"] = sorted((r["relative_path"], r["content_hash"]) for r in g.files.collect())
    return out


def test_index_and_incremental_equal_full(spark, tmp_path):
    root = tmp_path / "p"
    write(root, FILES)
    assert "dist/x.ts" not in list_tree(str(root)) and "notes.md" not in list_tree(str(root))
    store = Store(spark, f"file://{tmp_path}/store")
    assert index(spark, str(root), store) == 1
    g = store.graph()
    ids = {r["qualified_name"]: r["id"] for r in g.symbols.collect()}
    start = Q.callees(g, ids["src/app.ts::App.start"]).collect()
    assert [(r["target_qualified_name"], r["confidence"], r["provenance"]) for r in start] == [("src/utils.ts::helper", "high", "resolved")]
    impl = {r["source_qualified_name"]: r["kind"] for r in Q.implementations(g, ids["src/inv.cs::Acme.IInv"]).collect()}
    assert impl == {"src/inv.cs::Acme.Inv": "implements"}
    u = {(r["kind"], r["target_text"], r["reason"]) for r in Q.unresolved_rows(g).collect()}
    assert ("calls", "other", "no matching symbol in project") in u and ("imports", "./nowhere", "module not found in project") in u
    ext = {r["target_external"] for r in g.relationships.where("kind = 'imports'").collect()}
    assert {"rxjs", "System"} <= ext
    assert update(spark, str(root), store)[1] == []

    (root / "src/n3.ts").write_text("export function fn3() { return helper(); }\n")
    (root / "src/n5.ts").unlink()
    (root / "src/n20.ts").write_text("export function other() {}\n")
    version, changes = update(spark, str(root), store)
    assert version == 2 and dict(changes) == {"src/n3.ts": "modified", "src/n5.ts": "deleted", "src/n20.ts": "created"}
    fresh = Store(spark, f"file://{tmp_path}/fresh")
    index(spark, str(root), fresh)
    assert tables(store) == tables(fresh)
    assert store.manifest()["pending_files"] == 0
