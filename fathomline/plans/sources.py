"""Source files of many shapes, made from the parts table by SQL that Spark and DuckDB evaluate alike.

`~` stands for a single quote, `§` for a dollar sign, `{k}` for the part's key, `{s}` for its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import read, spread

#: (path, content) by shape.
SHAPES = (
    ("src/items/item{k}.controller.ts", """import { Router } from ~express~;

@Controller(~items~)
export class Item{k}Controller {
  constructor(private readonly items: ItemService) {}

  @Get(~/items/{k}~)
  async findOne(req, res) {
    const LIMIT = process.env.MAX_ITEMS || ~{s}~;
    if (req.params.id >= LIMIT) { throw new Forbidden(~no item {k}~); }
    const rows = await this.db.query(~SELECT * FROM item_{s} JOIN stock ON stock.id = item_{s}.id~);
    console.log(rows);
    const more = await loader.loadBatch(rows);
    return res.json({ text: "a { brace", rows });
  }

  async publishItem(message) {
    await this.channel.assertQueue(~item.created.{s}~);
    return this.bus.publish(~items.exchange~, ~item.created~, message);
  }
}

export const MAX_RETRY = {s};
export function plainHelper{k}(value) {
  return Math.max(value, {s});
}
"""),
    ("app/Http/Order{k}Action.php", """<?php
namespace App;

class Order{k}Action extends Model
{
    const BASE = ~/api/v{s}~;
    const ORDERS = self::BASE . ~/orders/{k}~;

    public function handle($request)
    {
        $input = $_POST[~order~];
        /* a block comment about why orders
           are checked twice for {s} */
        $row = DB::table(~orders_{s}~)->where(~id~, $input)->get();
        return Helper::requestAPI(Order{k}Action::ORDERS);
    }

    private function check($order)
    {
        if ($order->total === 0) { throw new ValidationError(~empty order {k}~); }
        $this->client->postParams(~notify_{s}~, $order);
    }
}
"""),
    ("db/migrations/17{k}_create_item.sql", """-- items of size {s}
-- kept for {k} days
CREATE TABLE IF NOT EXISTS item_{s} (id INT, name TEXT);

-- filled once
INSERT INTO item_{s} SELECT id, name FROM part_{k};
UPDATE item_{s} SET name = ~none~ WHERE name IS NULL;
DELETE FROM stock WHERE id = {k}
"""),
    ("docs/en/guide-{k}.md", """---
title: Guide {k}
repos: [repo-{s}, repo-base]
---
# Guide {k}

Intro about item_{s} and its status.

## How items flow
The route `/items/{k}` calls Item{k}Controller::FIND and writes to `item_{s}`.

```mermaid
graph TD
  A{k}[Client] --> B[item service]
```

## Glossary
* **PAMM {s}**: a shared account of kind {s}
* Lot: {s} units of trade

### Details
Short.

## Limits
At most {s} items are kept in the queue.
"""),
    ("cmd/worker{k}.go", """package main

type Worker{k} struct {
	Name string
}

func main() {
	http.HandleFunc("/health/{k}", health)
	queue := os.Getenv("QUEUE_{s}")
	ch.QueueDeclare("jobs.{s}", true)
}

func (w *Worker{k}) Run(count int) error {
	for i := 0; i < count; i++ {
		w.step(i)
	}
	return nil
}
"""),
    ("package.json", """{
  "name": "service-{k}",
  "version": "1.{s}.0",
  "scripts": { "start": "node .", "test": "jest" },
  "dependencies": { "express": "^4.{s}", "amqplib": "0.10" }
}
"""),
    ("config/service{k}.yaml", """server:
  port: 80{s}
  host: localhost

queue:
  name: jobs.{s}
  retries: 3

limits:
  items: {s}
"""),
    (".env.example", """# service {k}
DB_HOST=localhost
DB_PORT=33{s}

QUEUE_NAME=jobs.{s}
"""),
    ("src/routes/routes{k}.js", """const handlers = require(~../handlers/item{k}~);
const client = require(~./client~);

module.exports = [
  { method: [~GET~], alias: ~item.list~, url: ~/v{s}/items/~, handler: handlers.item{k}.list },
  { method: [~POST~], alias: ~item.add~, url: ~/v{s}/items/add~, handler: handlers.item{k}.add },
];

async function load{k}(body) {
  const reply = await rpc.call({ func: ~getPart{s}~, body });
  const other = await client.postParamsAsync(~syncPart{s}~, body);
  return reply.rows || other;
}

async function loadBatch(ids) {
  return ids.length;
}

app.get(~/legacy/{k}~, load{k});
"""),
    ("src/jobs/nightly{k}.ts", """// nightly job of repository {k}: keeps the status of
// every order that is older than {s} days up to date
// because reports read it at noon
cron.schedule(~0 {s} * * *~, runNightly{k});

@Cron(CronExpression.EVERY_HOUR)
async function runNightly{k}() {
  const url = process.env.REPORT_URL ?? ~http://report-{s}/api~;
  const answer = await axios.post(`§{url}/orders`, { status: ~ACTIVE~ });
  const also = await fetch(~http://stock-{s}/v1/items~);
  setInterval(refresh, 60000);
  channel.sendToQueue(~jobs.{s}~, Buffer.from(~x~));
  channel.consume(~done.{s}~, onDone);
  return answer.data;
}
"""),
    ("src/constants/accounts{k}.ts", """export const ACCOUNT_TYPES = [
  { name: ~Standard {s}~, code: ~STD{k}~, minimum: {s} },
  { name: ~Pro~, code: ~PRO{k}~, minimum: 1{s} },
  { name: ~Silver~, code: ~SLV{k}~, minimum: 2{s} },
];

export const ORDER_STATUS = { NEW: ~new~, PAID: ~paid~, LATE_{s}: ~late~ };
"""),
    ("test/item{k}.spec.ts", """describe(~item {k}~, () => {
  it(~finds it~, async () => {
    expect(await find({k})).toEqual({s});
  });
});
"""),
)


def _literal(text: str) -> str:
    assert "'" not in text and "\\" not in text
    return f"'{text}'"


def _case(column: int) -> str:
    return "CASE p_partkey % " + str(len(SHAPES)) + " " + " ".join(f"WHEN {i} THEN {_literal(s[column])}" for i, s in enumerate(SHAPES)) + " END"


def _filled(expression: str) -> str:
    return f"replace(replace(replace(replace({expression}, '~', chr(39)), '§', chr(36)), '{{k}}', CAST(p_partkey AS VARCHAR(20))), '{{s}}', CAST(p_size AS VARCHAR(20)))"


#: file_id, repo, branch, path, content, project_ids, tag_sources
SOURCES = f"""SELECT p_partkey AS file_id, concat('repo-', CAST(p_partkey % 7 AS VARCHAR(20))) AS repo,
 CASE WHEN p_partkey % 5 = 0 THEN 'develop' ELSE 'main' END AS branch, {_filled(_case(0))} AS path, {_filled(_case(1))} AS content FROM part"""


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread(read(spark, sf_dir, "part")).createOrReplaceTempView("_part_sources")
    return spark.sql(SOURCES.removesuffix("part") + "_part_sources")


def with_sources(body: str, *more: str) -> str:
    """DuckDB SQL with the table `sources` and further common table expressions before it."""
    parts = ", ".join([f"sources AS ({SOURCES})", *more])
    body = body.strip()
    return f"WITH {parts}, {body[5:]}" if body.startswith("WITH ") else f"WITH {parts} {body}"
