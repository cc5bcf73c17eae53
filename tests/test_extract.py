from collections import Counter

from quillgraph.operators.extract import csharp, web
from quillgraph.operators.extract.run import rows
from quillgraph.sources.tree import Config, Ignore, tsconfig_aliases

TS = """
import { Base, helper as h } from './base';
import * as fs from 'fs';
import Def from './def';
export { thing } from './thing';
export class Service extends Base<string> implements Face, Other {
  private items: Item[] = [];
  constructor(private repo: Repo, count: number) { super(); this.load(); }
  load(): Result { const x = new Widget(); helper(x); return `a ${inner(1)}` as any; }
  static make(a: Face) { return /re(g)/.test(a); }
}
interface Face { go(): void }
export function helper(x: Widget) { function nested() { deep(); } return nested(); }
const outside = call();
"""


def test_typescript():
    a = web.analyze("src/a.ts", "typescript", TS)
    kinds = Counter(s.kind for s in a.symbols)
    assert kinds == {"class": 1, "constructor": 1, "method": 2, "interface": 1, "function": 1}
    e = {(x.kind, x.target) for x in a.edges}
    assert {("inherits", "Base"), ("implements", "Face"), ("implements", "Other"), ("imports", "Base"), ("imports", "helper"), ("imports", "*"), ("imports", "default"), ("exports", "thing"), ("calls", "load"), ("constructs", "Widget"), ("calls", "helper"), ("calls", "inner"), ("references", "Repo"), ("references", "Result"), ("references", "Widget"), ("calls", "deep")} <= e
    assert ("calls", "call") not in e and ("references", "number") not in e
    assert next(s for s in a.symbols if s.name == "load").qualified_name == "src/a.ts::Service.load"


ANGULAR = """
import { Component, Injectable, NgModule, Inject } from '@angular/core';
@Injectable() export class UserStore { constructor(private http: HttpClient, @Inject(TOKEN) private t: any) {} }
@Component({ selector: 'x' }) export class Page { private svc = inject(UserStore); }
@NgModule({ imports: [CommonModule], providers: [UserStore, { provide: HTTP_INTERCEPTORS, useClass: Auth, multi: true }] }) export class App {}
export const routes: Routes = [{ path: 'users', component: Page, canActivate: [Guard], children: [{ path: ':id', component: Detail }] }, { path: 'lazy', loadComponent: () => import('./l').then(m => m.Lazy) }, { path: 'c', loadChildren: () => import('./c') }];
"""


def test_angular():
    a = web.analyze("src/app.ts", "typescript", ANGULAR)
    assert next(s for s in a.symbols if s.name == "UserStore").roles == {"service", "repository"}
    e = {(x.kind, x.target, x.reason, x.confidence) for x in a.edges}
    assert {("injects", "HttpClient", "di:ctor-param:0", "high"), ("injects", "TOKEN", "di:token:1", "medium"), ("injects", "UserStore", "di:inject-fn", "high"), ("registeredas", "Auth", "key:providers:HTTP_INTERCEPTORS", "high"), ("registeredas", "CommonModule", "key:imports", "high"), ("handlesroute", "Page", "route:/users", "high"), ("handlesroute", "Detail", "route:/users/:id", "high"), ("registeredas", "Guard", "key:canActivate", "high"), ("handlesroute", "Lazy", "route:/lazy", "medium")} <= e
    assert {x.target for x in a.edges if x.kind == "decorates"} >= {"Injectable", "Component", "NgModule", "Inject"}


CS = """
using System.Linq;
using static Acme.Util;
using Alias = Acme.Thing;
namespace Acme.Core;
[ApiController]
[Route("api/[controller]")]
public class OrdersController : ControllerBase, IOrders {
  private readonly Repo _repo, _other;
  public List<Order> Orders { get; set; } = new();
  public OrdersController(Repo repo) { _repo = repo; }
  [HttpGet("{id}")] public async Task<Order> Get(int id) { var x = new Order(1); Order y = new(); _repo.Find(id); return x.Name; }
  protected internal int Count => _repo.Size;
  class Inner { }
}
public partial class P { } public partial class P { }
public record Money(decimal Amount);
public enum Colour { Red, Green = 2 }
public class ShopDbContext : DbContext { public DbSet<Order> Orders { get; set; } }
"""


def test_csharp():
    a = csharp.analyze("src/a.cs", CS)
    by = {s.name: s for s in a.symbols}
    assert by["Acme.Core"].kind == "namespace" and by["Get"].qualified_name == "src/a.cs::Acme.Core.OrdersController.Get"
    assert by["Count"].visibility == "protectedinternal" and by["Money"].is_record and by["Red"].kind == "field"
    assert [s.ordinal for s in a.symbols if s.name == "P"] == [0, 1]
    assert {"_repo", "_other", "Orders", "Inner"} <= set(by)
    e = {(x.kind, x.target, x.reason) for x in a.edges}
    assert {("imports", "System.Linq", None), ("imports", "Acme.Util", "static"), ("imports", "Acme.Thing", "alias:Alias"), ("usestype", "ControllerBase", "c# base list entry"), ("usestype", "Order", "c# property/field declared type"), ("constructs", "Order", None), ("calls", "Find", None), ("reads", "Name", None), ("handlesroute", "GET api/Orders/{id}", "attribute route"), ("persiststo", "Order", "dbset:Orders")} <= e
    assert any(x.kind == "constructs" and x.target == "" for x in a.edges)
    assert next(s for s in a.symbols if s.name == "OrdersController").roles == {"controller"} and by["Get"].roles == {"route"}


MINIMAL = """
var builder = WebApplication.CreateBuilder(args);
builder.Services.AddScoped<IRepo, Repo>();
builder.Services.AddSingleton(typeof(IGen<>), typeof(Gen<>));
builder.Services.AddDbContext<Shop>();
builder.Services.AddOpenApi();
var app = builder.Build();
app.UseAuthorization();
app.UseMiddleware<Audit>();
app.MapGet("/orders/{id}", Handlers.Get);
app.MapGroup("/v1").MapPost("/orders", (Order o) => o);
app.Run();
"""


def test_minimal_api():
    a = csharp.analyze("Program.cs", MINIMAL)
    assert [s.qualified_name for s in a.symbols] == ["Program.cs::Program.Main"]
    e = {(x.kind, x.target, x.tag, x.confidence) for x in a.edges}
    assert {("registeredas", "IRepo", "unresolved", "high"), ("registeredas", "Repo", "unresolved", "high"), ("registeredas", "IGen", "unresolved", "low"), ("registeredas", "Shop", "unresolved", "high"), ("registeredas", "OpenApi", "unresolved", "high"), ("registeredas", "Authorization", "unresolved", "high"), ("registeredas", "Audit", "unresolved", "high"), ("handlesroute", "GET /orders/{id}", "external", "high"), ("handlesroute", "Get", "unresolved", "high"), ("handlesroute", "POST /v1/orders", "external", "high")} <= e


def test_broken_sources_give_rows():
    for text in ("", "class", "class A {", "import {", "export", "function (", "}}}}", "@", "const routes: Routes = [", "`${", "public class", "namespace", "[", "new ("):
        assert rows("x.ts", "typescript", text) and rows("x.cs", "csharp", text)


def test_config_ignore_and_aliases():
    c = Config.from_toml("[index]\nlanguages = ['csharp']\n[index.watch]\ndebounce_ms = 9\n[other]\nx = 1\n")
    assert c.languages == ("csharp",) and c.debounce_ms == 9 and c.max_limit == 500
    assert Config.from_toml(c.to_toml()) == c
    i = Ignore(["*.log", "/dist/", "!keep.log", "a/**/b", "# x"])
    assert i.verdict("x/y.log", False) and i.verdict("keep.log", False) is False and i.verdict("dist", True) and i.verdict("x/dist", True) is None and i.verdict("a/q/r/b", False) and i.verdict("a/b", False)
    assert tsconfig_aliases('{"compilerOptions": {"paths": {"@a/*": ["s/*"]}}}') == [("@a/*", "s/*")] and tsconfig_aliases(None) == []
