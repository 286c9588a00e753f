"""Extractors of brace languages on inline sources."""

from __future__ import annotations

import pytest

from tests.test_sources import graph

SAMPLES = {
    "ui/a.ts": "export function helper() { return 1; }\nexport function main() { return helper(); }\n",
    "A/B.cs": "using System;\nnamespace N {\npublic class B {\n  public int Helper() { return 1; }\n  public int Main() { return Helper(); }\n}}\n",
    "src/a.rs": "fn helper() -> i32 { 1 }\nfn main_fn() -> i32 { helper() }\n",
    "x/B.java": "package x;\npublic class B {\n  int helper() { return 1; }\n  public int main() {\n    return helper();\n  }\n}\n",
}


@pytest.mark.parametrize("path", SAMPLES)
def test_same_file_calls(path):
    nodes, edges, errors = graph(path, SAMPLES[path])
    assert not errors
    found = [d for (_, d, t), e in edges.items() if t == "calls" and e["confidence"] == "HIGH"]
    assert found and all(d in nodes for d in found)


def calls(text, path="svc/a.ts"):
    return {(a, b, e["confidence"]) for (a, b, t), e in graph(path, text)[1].items() if t == "calls"}


def test_typescript_calls():
    assert ("ts:class:Svc#n", "ts:class:Svc#m", "HIGH") in calls("export class Svc {\n  m() { return 1; }\n  n() { return this.m(); }\n}\n")
    assert ("ts:func:g", "ts:func:f", "HIGH") in calls("export function g() { return f(); }\nexport function f() { return 1; }\n")
    assert ("ts:class:T#show", "ts:func:w", "HIGH") in calls("export function w() { return 1; }\nexport class T {\n  show() { return w(1); }\n}\n")
    assert calls("export class A {\n  m() { return 1; }\n}\nexport class B {\n  n() { return m(); }\n}\n") == {("ts:class:B#n", "unresolved:call:m", "LOW")}
    assert calls("export function g() { return 1; }\n// proxy error (notacall)\n") == set()


@pytest.mark.parametrize(("text", "want"), [
    ("fetch('/api/items', {method: 'POST', body: '{}'});", "endpoint:POST /api/items"), ("fetch('/api/other', {method: m, body: '{}'});", "endpoint:* /api/other"),
    ("fetch('/api/plain/')", "endpoint:GET /api/plain"), ("axios.put('/api/x/12')", "endpoint:PUT /api/x/{id}"),
    ("axios({url: '/api/c', headers: {a: 1}, method: 'DELETE'})", "endpoint:DELETE /api/c"), ("this.http.get<X>('/api/h?y=1')", "endpoint:GET /api/h"),
    ("this.http.request('PATCH', '/api/r')", "endpoint:PATCH /api/r"),
])
def test_typescript_http(text, want):
    nodes, edges, _ = graph("ui/form.ts", text + "\n")
    assert {i for i in nodes if i.startswith("endpoint:")} == {want}
    assert [e["confidence"] for (_, _, t), e in edges.items() if t == "consumes"] == ["LOW"]


def test_typescript_roles_and_routes():
    nodes, edges, _ = graph("ui/app.ts", """import { Routes } from '@angular/router';
import { X } from './x';
@Component({selector: 'a'})
export class AppComponent {}
export class AuthGuard implements CanActivate {}
@Injectable()
export class Api {}
const routes = [{ path: 'home', canActivate: [AuthGuard], component: AppComponent }];
""")
    assert nodes["ts:component:AppComponent"]["kind"] == "component" and nodes["ts:guard:AuthGuard"]["kind"] == "guard" and nodes["ts:service:Api"]["kind"] == "service"
    assert ("route:/home", "unresolved:guard:AuthGuard", "guarded-by") in edges and ("route:/home", "unresolved:component:AppComponent", "navigates") in edges
    assert ("file:ui/app.ts", "unresolved:module:./x", "imports") in edges


def test_java():
    nodes, edges, _ = graph("src/main/Order.java", """package com.shop;
@RestController
@RequestMapping("/orders")
public class OrderController {
  private final OrderService service;
  public OrderController(OrderService service) { this.service = service; }
  @PostMapping("/new")
  public Order create(String x) {
    db.run("INSERT INTO widget (id) VALUES (1)");
    return new Order();
  }
}
""")
    assert nodes["java:class:com.shop.OrderController"]["kind"] == "controller"
    assert ("endpoint:POST /orders/new", "java:method:com.shop.OrderController#create", "handled-by") in edges
    assert edges["java:class:com.shop.OrderController", "unresolved:class:OrderService", "injects"]["confidence"] in ("HIGH", "MEDIUM")
    assert edges["java:method:com.shop.OrderController#create", "table:widget", "writes"]["confidence"] == "MEDIUM"
    nodes, edges, _ = graph("E.java", '@Entity\n@Table(name = "claims")\npublic class Claim {\n}\n')
    assert edges["java:class:Claim", "table:claims", "maps-to"]["confidence"] == "HIGH"
    _, edges, _ = graph("R.java", "interface ClaimRepo extends JpaRepository<Claim, Long> {\n}\n")
    assert ("java:class:ClaimRepo", "entity:Claim", "reads") in edges


def test_csharp():
    nodes, edges, _ = graph("C.cs", """namespace Shop {
[Table("orders")]
public class Order { }
public class ShopContext : DbContext { public DbSet<Order> Orders { get; set; } }
public class OrdersController {
  [HttpGet("list")]
  public string List() { return conn.Query("SELECT id FROM widget"); }
}}
""")
    assert nodes["cs:class:Shop.OrdersController"]["kind"] == "controller"
    assert ("endpoint:GET /list", "cs:method:Shop.OrdersController#List", "handled-by") in edges
    assert ("cs:class:Shop.Order", "table:orders", "reads") in edges
    assert ("cs:method:Shop.OrdersController#List", "table:widget", "reads") in edges


def test_rust():
    nodes, edges, _ = graph("src/m.rs", """use crate::db::Pool;
use std::io;
pub struct Store { a: i32 }
impl Store {
    pub fn load(&self) -> i32 { self.one() }
    fn one(&self) -> i32 { 1 }
}
#[get("/items")]
async fn items() -> String { let q = "DELETE FROM widget"; q }
""")
    assert ("rs:method:Store#load", "rs:method:Store#one", "calls") in edges
    assert ("endpoint:GET /items", "rs:fn:items", "handled-by") in edges
    assert edges["file:src/m.rs", "table:widget", "writes"]["confidence"] == "LOW"
    assert ("file:src/m.rs", "unresolved:module:crate::db::Pool", "imports") in edges
    assert not any("std" in d for _, d, t in edges if t == "imports")
