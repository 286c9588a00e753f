"""Small sources for the queries that drive extraction, detection and incremental runs. What they should
yield is written out in sample_queries.py."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

SOURCES = {
    "app/api.py": '''import requests
from fastapi import FastAPI
app = FastAPI()

class Item(Base):
    __tablename__ = "items"

    def save(self):
        db.execute("INSERT INTO items (id) VALUES (1)")

@app.get("/items")
def list_items():
    check()
    db.execute("SELECT * FROM items JOIN owners ON 1 = 1")

def check():
    requests.get("/health")
''',
    "db/V2__orders.sql": '''CREATE TABLE orders (id INT, total DECIMAL(10, 2), PRIMARY KEY (id));
CREATE VIEW open_orders AS SELECT * FROM orders;
INSERT INTO items VALUES (1);
''',
    "cmd/main.go": '''package main

import "example.com/shop/cart"

type Server struct {}

func (s *Server) Serve() {
	http.HandleFunc("/cart", s.Cart)
}
''',
    "src/main/java/shop/OrderController.java": '''package shop;

@RestController
@RequestMapping("/orders")
public class OrderController {
  private final OrderService orders;

  @GetMapping("/open")
  public String open() {
    return orders.open();
  }
}
''',
    "web/page.ts": '''import { x } from './x';
export class PageService {
  load() { return this.http.get('/orders/open?all=1'); }
}
fetch('/items/17', { method: 'DELETE' });
''',
    "deploy/docker-compose.yml": '''services:
  db:
    image: postgres
  queue:
    image: rabbitmq
volumes:
  data:
''',
    "config/app.properties": '''# names only
store.url=jdbc:postgresql://${DB_HOST}/shop
mail.smtp.host=localhost
''',
    "requirements.txt": "fastapi==0.1\nrequests>=2\n",
}


def sources(spark: SparkSession, changed: dict[str, str | None] | None = None) -> DataFrame:
    """(path, content, sha256) of the sources, some changed or (with None) gone."""
    texts = {k: v for k, v in {**SOURCES, **(changed or {})}.items() if v is not None}
    rows = [(p, t.encode(), hashlib.sha256(t.encode()).hexdigest()) for p, t in sorted(texts.items())]
    return spark.createDataFrame(rows, "path string, content binary, sha256 string")
