"""What is written: tables, SQL text, JSON lines, metrics text, reports, the lock timeline page, pending commands."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions.scalars import humanise
from timberline.operators.tables import Tables
from timberline.plans import schemas as S
from timberline.plans.reports import REPORT, LogTables, Thresholds, run_report

TIME_FORMAT = "yyyy/MM/dd HH:mm:ss"


def file_name(name: str, suffix: str, logs: list[str]) -> str:
    """``name``, or the first log's name without ``.gz`` and ``.log``, ending in ``suffix``."""
    if not name:
        name = logs[0] if logs else "logs"
        for tail in (".gz", ".log"):
            name = name.removesuffix(tail)
    return name if name.endswith(suffix) else name + suffix


def write_tables(tables: Tables, path: str, mode: str = "error") -> None:
    """Parquet tables; commands partitioned by the day they ended, so that reports on days read only those."""
    end_date = F.coalesce(F.to_date("endTime"), F.to_date("startTime"))
    tables.process.withColumn("end_date", end_date).write.mode(mode).partitionBy("end_date").parquet(f"{path}/process")
    tables.table_use.write.mode(mode).parquet(f"{path}/tableUse")
    tables.events.write.mode(mode).parquet(f"{path}/events")


def read_tables(spark: SparkSession, path: str) -> LogTables:
    """The tables a report reads; raises if one is missing."""
    return LogTables(*(spark.read.parquet(f"{path}/{name}") for name in ("process", "tableUse", "events")))


def _literal(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind == "timestamp":
        return F.coalesce(F.concat(F.lit("'"), F.date_format(c, TIME_FORMAT), F.lit("'")), F.lit("''"))
    if kind == "string":
        return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))
    if kind == "boolean":
        return F.when(c, F.lit("1")).otherwise(F.lit("0"))
    return F.format_string("%.3f", c) if kind == "double" else c.cast("string")


def sql_inserts(df: DataFrame, table: str, columns: tuple[str, ...]) -> DataFrame:
    """(value): an INSERT per row, columns named and quotes doubled."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    values = F.concat_ws(",", *(F.coalesce(_literal(c, kinds[c]), F.lit("NULL")) for c in columns))
    return df.select(F.concat(F.lit(f"INSERT INTO {table} ({','.join(columns)}) VALUES ("), values, F.lit(");")).alias("value"))


def create_statement(table: str, df: DataFrame, columns: tuple[str, ...], key: tuple[str, ...]) -> str:
    types = {"bigint": "INT", "double": "FLOAT", "timestamp": "DATETIME", "boolean": "TEXT"}
    kinds = {f.name: types.get(f.dataType.simpleString(), "TEXT") for f in df.schema.fields}
    parts = [f"{c} {kinds[c]}" for c in columns] + [f"PRIMARY KEY ({', '.join(key)})"] * bool(key)
    return f"CREATE TABLE IF NOT EXISTS {table} ({', '.join(parts)});"


def write_sql(tables: Tables, path: str) -> None:
    """SQL text: the tables' definitions, then inserts in one transaction for each part file."""
    spark = tables.process.sparkSession
    parts = {"process": (tables.process, S.PROCESS_COLUMNS, ("processkey", "lineNumber")), "tableUse": (tables.table_use, S.TABLE_USE_COLUMNS, ("processkey", "lineNumber", "tableName")), "events": (tables.events, S.EVENT_COLUMNS, ("lineNumber",))}
    heads = [(create_statement(name, df, columns, key),) for name, (df, columns, key) in parts.items()]
    spark.createDataFrame(heads, "value string").coalesce(1).write.mode("overwrite").text(f"{path}/schema")
    for name, (df, columns, _) in parts.items():
        sql_inserts(df, name, columns).write.mode("overwrite").text(f"{path}/{name}")


def json_lines(parsed: DataFrame) -> DataFrame:
    """(log_id, emitted, value): a JSON object per command or event; tables as an array by name, blank times left out."""
    command = F.to_json(F.col("command"), {"timestampFormat": TIME_FORMAT})
    event = F.to_json(F.col("event"), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'"})
    return parsed.select("log_id", "emitted", F.coalesce(command, event).alias("value"))


def write_json(parsed: DataFrame, path: str, mode: str = "append") -> None:
    json_lines(parsed).sortWithinPartitions("log_id", "emitted").select("value").write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def pending_json(pending: DataFrame) -> DataFrame:
    return pending.select(F.to_json(F.struct(*pending.columns), {"timestampFormat": TIME_FORMAT}).alias("value"))


def render_report(tables: LogTables, form: str = "text", thresholds: Thresholds | None = None, sections: tuple[str, ...] | None = None) -> str:
    """The report as text, json, csv or html. Its queries give short tables, which the driver formats."""
    found = run_report(tables, thresholds, *([sections] if sections else []))
    out, data = [], {}
    for name, df in found.items():
        section, title, _ = REPORT[name]
        rows = [[("" if v is None else str(v)) for v in r] for r in df.collect()]
        columns = df.columns
        data[name] = {"section": section, "title": title, "rows": [dict(zip(columns, r, strict=True)) for r in rows]}
        if form == "csv":
            out += [f"# {title}", ",".join(columns), *(",".join('"' + v.replace('"', '""') + '"' for v in r) for r in rows), ""]
        elif form == "html":
            cell = lambda tag, vs: "<tr>" + "".join(f"<{tag}>{html.escape(v)}</{tag}>" for v in vs) + "</tr>"
            out += [f"<h2>{html.escape(title)}</h2><table>", cell("th", columns), *(cell("td", r) for r in rows), "</table>"]
        elif form == "text":
            widths = [max(len(x[i]) for x in [columns, *rows]) for i in range(len(columns))]
            row = lambda vs: "  ".join(v.ljust(w) for v, w in zip(vs, widths, strict=True)).rstrip()
            out += [title, row(columns), *map(row, rows), ""]
    if form == "json":
        return json.dumps(data, indent=1)
    if form not in ("text", "csv", "html"):
        raise ValueError(f"no such form: {form}")
    return f"<!DOCTYPE html><html><body>{''.join(out)}</body></html>" if form == "html" else "\n".join(out)


# A page of lock records: its rows are data, which the page draws on a time axis and filters by text.
_PAGE_HEAD = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>Locks</title><style>
.r{position:relative;height:18px;font:12px sans-serif;border-bottom:1px solid #eee}.r b{position:absolute;height:14px;top:2px;min-width:1px}
.wait{background:#ccc}.held{background:#c33}.r span{position:relative}</style></head><body><h1>Locks</h1>
<input id="only" placeholder="table, user or command"> <span id="count"></span><div id="axis"></div><div id="rows"></div><script>const rows="""
_PAGE_TAIL = """;
const end=r=>r.at+r.wait+r.held,from=rows.reduce((m,r)=>Math.min(m,r.at),Infinity),span=Math.max(1,rows.reduce((m,r)=>Math.max(m,end(r)),-Infinity)-from);
function bar(kind,at,ms){const b=document.createElement('b');b.className=kind;b.style.left=100*(at-from)/span+'%';b.style.width=100*ms/span+'%';return b}
function draw(){const want=document.getElementById('only').value.toLowerCase(),box=document.getElementById('rows');box.textContent='';let n=0;
for(const r of rows){const text=r.label+' '+r.cmd+' '+r.user+' pid '+r.pid+' '+r.lasted;if(!text.toLowerCase().includes(want))continue;n++;
const d=document.createElement('div'),t=document.createElement('span');d.className='r';d.title=text+' '+r.start;t.textContent=r.label;d.append(bar('wait',r.at,r.wait),bar('held',r.at+r.wait,r.held),t);box.append(d)}
document.getElementById('count').textContent=n+' of '+rows.length+' records'}
if(rows.length)document.getElementById('axis').textContent=new Date(from).toISOString()+' to '+new Date(from+span).toISOString();
document.getElementById('only').oninput=draw;draw()</script></body></html>"""


def lock_pages(records: DataFrame, page_rows: int = 10_000) -> DataFrame:
    """(page, rows, html): all lock records by time, ``page_rows`` to a page; no row is left out.

    Records are counted, sorted by range in parts of about a hundred pages, and each part is cut into pages, so only
    a page's rows are ever put together. No records give no pages.
    """
    label = F.concat_ws(" ", "table", "side")
    begin = F.unix_millis(F.col("start").cast("timestamp"))
    bar = F.struct(begin.alias("at"), label.alias("label"), "line", "pid", "cmd", "user", F.date_format("start", TIME_FORMAT).alias("start"), "wait", "held", humanise(F.col("max_lock")).alias("lasted"))
    parts = max(1, -(-records.count() // (100 * page_rows)))
    rows = records.select(bar.alias("r")).repartitionByRange(parts, "r").sortWithinPartitions("r").withColumn("m", F.monotonically_increasing_id())
    part, place = F.shiftright("m", 33), F.col("m").bitwiseAND((1 << 33) - 1)
    paged = rows.groupBy(part.alias("part"), F.floor(place / page_rows).alias("place")).agg(F.count("*").alias("rows"), F.sort_array(F.collect_list("r")).alias("data"))
    # An opened tag could end the script that holds the data.
    data = F.replace(F.to_json("data"), F.lit("<"), F.lit("\\u003c"))
    return paged.select(F.shiftleft("part", 33).bitwiseOR(F.col("place")).alias("page"), "rows", F.concat(F.lit(_PAGE_HEAD), data, F.lit(_PAGE_TAIL)).alias("html"))


def write_lock_pages(records: DataFrame, path: str, page_rows: int = 10_000) -> None:
    """A folder for each page, in the order of time."""
    lock_pages(records, page_rows).select("page", "html").write.mode("overwrite").partitionBy("page").text(path)


def lock_page(records: DataFrame, limit: int = 10_000) -> str:
    """One page with all lock records; raises if they are more than ``limit``, for which ``write_lock_pages`` is there."""
    if (rows := records.limit(limit + 1).count()) > limit:
        raise ValueError(f"more than {limit} lock records; write_lock_pages writes them all")
    if not rows:
        return f"{_PAGE_HEAD}[]{_PAGE_TAIL}"
    return lock_pages(records, limit).first()["html"]


def write_proxy(rows: DataFrame, path: str, form: str = "parquet") -> None:
    """The proxy table as Parquet, SQL text (definition and inserts) or JSON lines."""
    rows = rows.select(*S.PROXY_COLUMNS)
    if form == "parquet":
        rows.write.mode("overwrite").parquet(f"{path}/p4pcmd")
    elif form == "sql":
        head = create_statement("p4pcmd", rows, S.PROXY_COLUMNS, ())
        rows.sparkSession.createDataFrame([(head,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/schema")
        sql_inserts(rows, "p4pcmd", S.PROXY_COLUMNS).write.mode("overwrite").text(f"{path}/p4pcmd")
    elif form == "json":
        rows.select(F.to_json(F.struct(*S.PROXY_COLUMNS), {"timestampFormat": TIME_FORMAT}).alias("value")).write.mode("overwrite").text(f"{path}/p4pcmd")
    else:
        raise ValueError(f"no such form: {form}")
