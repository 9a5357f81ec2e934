"""Scanner exports written from the driver's tables, one file for each order, and read back by the readers.

The SQL counterparts compute the findings from the tables and never see the files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import documents, scans, tools
from .registry import Tables, query

_KEPT = ["file", "plugin_id", "title", "severity", "severity_score", "target"]
_SCORE = "round(l_discount * 100, 1)"
_BAND = f"CASE WHEN {_SCORE} >= 9 THEN 'CRITICAL' WHEN {_SCORE} >= 7 THEN 'HIGH' WHEN {_SCORE} >= 4 THEN 'MEDIUM' WHEN {_SCORE} > 0 THEN 'LOW' ELSE 'INFO' END"
_BASE = "CAST(l_orderkey AS VARCHAR) AS file"


def orders(t: Tables) -> DataFrame:
    """(file, items): the line items of each order; an order has at most a few. What is shuffled are their columns, once for
    all exports that are made of them; the lines of an export are many times as long."""
    rows = t("lineitem").withColumn("score", F.round(F.col("l_discount") * 100, 1)).select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity", "score").alias("r"))
    return rows.groupBy("l_orderkey").agg(F.collect_list("r").alias("items")).select(F.col("l_orderkey").cast("string").alias("file"), "items")


def content(line: Callable[[Column], Column], before: str = "", after: str = "", between: str = "\n") -> Column:
    """A file of the lines of an order's items, in order."""
    rows = F.sort_array(F.transform("items", lambda r: F.struct(r["l_linenumber"].alias("at"), line(r).alias("line"))))
    return F.concat(F.lit(before), F.array_join(F.transform(rows, lambda r: r["line"]), between), F.lit(after))


def exported(t: Tables, *contents: Column) -> DataFrame:
    """(file, content): a file of each kind for each order."""
    return orders(t).select("file", F.explode(F.array(*contents)).alias("content"))


def _f(text: str, *columns: str | Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A line with values of an item in the places of %s."""
    shown = lambda c, r: F.coalesce((c(r) if callable(c) else r[c]).cast("string"), F.lit("null"))
    first, *rest = text.split("%s")
    return lambda r: F.concat(F.lit(first), *[x for c, after in zip(columns, rest, strict=True) for x in (shown(c, r), F.lit(after))])


_flag = lambda a, b, c: lambda r: F.when(r["l_returnflag"] == "R", a).when(r["l_returnflag"] == "A", b).otherwise(c)
_sql_flag = lambda a, b, c: f"CASE l_returnflag WHEN 'R' THEN '{a}' WHEN 'A' THEN '{b}' ELSE '{c}' END"
_pk, _sk, _ln = "l_partkey", "l_suppkey", "l_linenumber"


def nessus_file() -> Column:
    line = _f('%s,CVE-2020-%s,%s,%s,h%s,tcp,%s,"Plugin, ""%s""","two\nlines"', _pk, lambda r: r[_sk] + 1000, "score", _flag("Critical", "Low", "None"), _sk, _ln, _pk)
    return content(line, "Plugin ID,CVE,CVSS v3.0 Base Score,Risk,Host,Protocol,Port,Name,Description\n")


@query("prs01_nessus_csv", f"""SELECT {_BASE}, CAST(l_partkey AS VARCHAR) AS plugin_id, 'Plugin, "' || l_partkey || '"' AS title,
  CASE l_returnflag WHEN 'R' THEN 'CRITICAL' WHEN 'A' THEN 'LOW' ELSE 'INFO' END AS severity, {_SCORE} AS severity_score,
  'h' || l_suppkey || ':' || l_linenumber || '/tcp' AS target, 'CVE-2020-' || (l_suppkey + 1000) AS cves FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_suppkey, l_linenumber ORDER BY CAST({_SCORE} AS VARCHAR), CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END) = 1""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    return scans.nessus_csv(exported(t, nessus_file())).select(*_KEPT, F.array_join("cve_list", ",").alias("cves"))


def qualys_file() -> Column:
    line = _f("10.0.0.%s,,%s,Item %s,%s,%s,5.5,%s", _sk, _pk, _pk, lambda r: F.when(r["l_returnflag"] == "N", "Ig").otherwise("Vuln"), lambda r: r[_ln] % 5 + 1, "score")
    return content(line, "Scan Results\nLaunch Date,today\nIP,DNS,QID,Title,Type,Severity,CVSS Base,CVSS3.1 Base\n")


@query("prs06_qualys_csv", f"""SELECT {_BASE}, CAST(l_partkey AS VARCHAR) AS plugin_id, 'Item ' || l_partkey AS title, {_SCORE} AS severity_score, '10.0.0.' || l_suppkey AS target,
  CASE WHEN l_returnflag = 'N' THEN 'INFO' ELSE CASE l_linenumber % 5 WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 1 THEN 'LOW' ELSE 'INFO' END END AS severity FROM lineitem""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    return scans.qualys_csv(exported(t, qualys_file())).select(_KEPT)


def openvas_file() -> Column:
    line = _f("10.0.0.1,web%s,%s,tcp,%s,%s,Test %s,1.3.%s,%s", _sk, _ln, _flag("High", "Log", ""), "score", _pk, _pk, lambda r: r["l_quantity"].cast("int") * 2)
    return content(line, "IP,Hostname,Port,Port Protocol,Severity,CVSS,NVT Name,NVT OID,QoD\n")


@query("prs05_openvas_csv", f"""SELECT {_BASE}, '1.3.' || l_partkey AS plugin_id, 'Test ' || l_partkey AS title, {_SCORE} AS severity_score, 'web' || l_suppkey || ' (10.0.0.1):' || l_linenumber || '/tcp' AS target,
  CASE l_returnflag WHEN 'R' THEN 'HIGH' WHEN 'A' THEN 'INFO' ELSE {_BAND} END AS severity,
  CASE WHEN l_quantity * 2 >= 95 THEN 'Certain' WHEN l_quantity * 2 >= 70 THEN 'Firm' ELSE 'Tentative' END AS confidence FROM lineitem""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    return scans.openvas_csv(exported(t, openvas_file())).select(*_KEPT, "confidence")


def nuclei_file() -> Column:
    def line(r: Column) -> Column:
        word = F.when(r["l_returnflag"] == "N", "unknown").otherwise("critical")
        info = F.struct(F.concat(F.lit("Template "), r[_pk]).alias("name"), word.alias("severity"), F.struct(r["score"].alias("cvss-score")).alias("classification"))
        return F.to_json(F.struct(F.concat(F.lit("cve-2021-"), r[_pk] + 1000).alias("template-id"), F.concat_ws("/", F.lit("http://h"), r[_ln].cast("string")).alias("matched-at"), info.alias("info")))

    return content(line)


@query("prs08_nuclei", f"""SELECT {_BASE}, 'cve-2021-' || (l_partkey + 1000) AS plugin_id, 'Template ' || l_partkey AS title, CASE l_returnflag WHEN 'N' THEN 'INFO' ELSE 'CRITICAL' END AS severity,
  {_SCORE} AS severity_score, 'http://h/' || l_linenumber AS target, 'CVE-2021-' || (l_partkey + 1000) AS cves FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_linenumber ORDER BY CASE l_returnflag WHEN 'N' THEN 2 ELSE 1 END, CAST({_SCORE} AS VARCHAR)) = 1""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    return scans.nuclei(exported(t, nuclei_file())).select(*_KEPT, F.array_join("cve_list", ",").alias("cves"))


def sarif_file() -> Column:
    line = _f('{"ruleId":"r%s","level":"%s","message":{"text":"Found %s. More"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"src/%s.c"},"region":{"startLine":%s}}}]}', _ln, _flag("error", "note", "warning"), _pk, _sk, _ln)
    rules = '{"id":"r1","shortDescription":{"text":"First"},"properties":{"security-severity":"9.1","tags":["cwe-079"]}}'
    return content(line, f'{{"version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"Lint","rules":[{rules}]}}}},"results":[', "]}]}", ",")


@query("prs11_sarif", f"""SELECT {_BASE}, 'r' || l_linenumber AS plugin_id, CASE l_linenumber WHEN 1 THEN 'First' ELSE 'Found ' || l_partkey END AS title,
  CASE WHEN l_linenumber = 1 THEN 'CRITICAL' WHEN l_returnflag = 'R' THEN 'HIGH' WHEN l_returnflag = 'A' THEN 'LOW' ELSE 'MEDIUM' END AS severity, CASE l_linenumber WHEN 1 THEN 9.1::DOUBLE END AS severity_score,
  'src/' || l_suppkey || '.c:' || l_linenumber AS target, CASE l_linenumber WHEN 1 THEN 'CWE-79' ELSE '' END AS cves FROM lineitem""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    return scans.sarif(exported(t, sarif_file())).select(*_KEPT, F.array_join("cve_list", ",").alias("cves"))


# Formats with one record a line item. `shown` is (title, severity, target) in SQL, and `skip` drops what isn't a finding.


def _format(name: str, reader, line: Callable[[Column], Column], before: str, after: str, between: str, shown: tuple[str, str, str], skip: str = "true") -> None:
    @query(name, f"SELECT {_BASE}, {shown[0]} AS title, {shown[1]} AS severity, {shown[2]} AS target FROM lineitem WHERE {skip}")
    def _(t: Tables) -> DataFrame:
        return reader(exported(t, content(line, before, after, between))).select("file", "title", "severity", "target")


_format("prs03_zap_json", tools.zap_json, _f('{"pluginid":"%s","alert":"Alert %s","riskcode":"%s","instances":[{"uri":"http://s%s/","param":"q"}]}', _pk, _pk, _flag("3", "1", "0"), _sk), '{"site":[{"@name":"http://x","alerts":[', "]}]}", ",",
        ("'Alert ' || l_partkey", _sql_flag("HIGH", "LOW", "INFO"), "'http://s' || l_suppkey || '/ [q]'"))
_format("prs03_zap_xml", tools.zap_xml, _f("<alertitem><alert>Alert %s</alert><riskcode>%s</riskcode><instances><instance><uri>http://s%s/</uri></instance></instances></alertitem>", _pk, _flag("2", "1", "0"), _sk), "<OWASPZAPReport><site name='x'><alerts>", "</alerts></site></OWASPZAPReport>", "",
        ("'Alert ' || l_partkey", _sql_flag("MEDIUM", "LOW", "INFO"), "'http://s' || l_suppkey || '/'"))
_format("prs04_burp_xml", tools.burp_xml, _f("<issue><serialNumber>1</serialNumber><name>Issue %s</name><host ip='1'>http://s%s</host><path>/p</path><severity>%s</severity></issue>", _pk, _sk, _flag("High", "Low", "Information")), "<issues>", "</issues>", "",
        ("'Issue ' || l_partkey", _sql_flag("HIGH", "LOW", "INFO"), "'http://s' || l_suppkey || '/p'"))
_format("prs05_openvas_xml", tools.openvas_xml, _f("<result><name>Test %s</name><host>10.0.0.%s<hostname>h</hostname></host><port>%s/tcp</port><nvt oid='1'/><threat>%s</threat><severity>5.0</severity></result>", _pk, _sk, _ln, _flag("High", "Log", "")), "<report><report><results>", "</results></report></report>", "",
        ("'Test ' || l_partkey", _sql_flag("HIGH", "INFO", "MEDIUM"), "'h (10.0.0.' || l_suppkey || '):' || l_linenumber || '/tcp'"))
_format("prs06_qualys_xml", tools.qualys_xml, _f("<IP value='10.0.0.%s' name='n'><VULNS><CAT port='%s'><VULN number='%s' severity='%s'><TITLE>Item %s</TITLE></VULN></CAT></VULNS></IP>", _sk, _ln, _pk, _flag("5", "3", "1"), _pk), "<SCAN>", "</SCAN>", "",
        ("'Item ' || l_partkey", _sql_flag("CRITICAL", "MEDIUM", "INFO"), "'10.0.0.' || l_suppkey || ' / n:' || l_linenumber"))
_format("prs07_trivy_json", scans.trivy, _f('{"Target":"img%s","Vulnerabilities":[{"VulnerabilityID":"CVE-2020-%s","PkgName":"p%s","Severity":"%s"}]}', _sk, lambda r: r[_pk] + 1000, _ln, _flag("CRITICAL", "LOW", "UNKNOWN")), '{"Results":[', "]}", ",",
        ("'CVE-2020-' || (l_partkey + 1000) || ' in p' || l_linenumber", _sql_flag("CRITICAL", "LOW", "INFO"), "'img' || l_suppkey"))
_format("prs07_trivy_table", tools.trivy_table, _f("├───┤\n│ lib%s │ CVE-2020-%s │ %s │ fixed │ 1 │ 2 │ flaw %s │\n│ │ │ │ │ │ │ of it │", _sk, lambda r: r[_pk] + 1000, _flag("HIGH", "LOW", "MEDIUM"), _pk), "img (os)\n========\n┌───┐\n│ Library │ Vulnerability │\n", "\n└───┘\n", "\n",
        ("'flaw ' || l_partkey || ' of it'", _sql_flag("HIGH", "LOW", "MEDIUM"), "'img (os)'"))
_format("prs09_testssl_csv", tools.testssl_csv, _f('"check%s","s%s.example/10.0.0.1","%s","%s","offered","",""', _pk, _sk, _ln, _flag("HIGH", "LOW", "OK")), '"id","fqdn/ip","port","severity","finding","cve","cwe"\n', "", "\n",
        ("'check' || l_partkey || ': offered'", _sql_flag("HIGH", "LOW", ""), "'s' || l_suppkey || '.example (10.0.0.1):' || l_linenumber"), "l_returnflag IN ('R', 'A')")
_format("prs10_nikto_json", tools.nikto_json, _f('{"host":"s%s","port":"80","vulnerabilities":[{"id":"1","url":"/p%s","msg":"%s"}]}', _sk, _pk, _flag("Server is outdated here", "Directory indexing found", "A default file is there")), "[", "]", ",",
        ("'Nikto: /p' || l_partkey || ': ' || " + _sql_flag("Server is outdated here", "Directory indexing found", "A default file is there"), _sql_flag("MEDIUM", "MEDIUM", "LOW"), "'s' || l_suppkey"))
_format("prs10_paths", tools.gobuster, _f("/%s%s   (Status: %s) [Size: 1]", _flag("backup", "page", "admin"), _pk, lambda r: F.element_at(F.array(F.lit("200"), F.lit("403"), F.lit("404")), (r[_ln] % 3 + 1).cast("int"))), "[+] Url: http://g\n", "", "\n",
        (f"CASE WHEN l_returnflag = 'A' THEN 'Discovered path: /' ELSE 'Exposed path discovered: /' END || {_sql_flag('backup', 'page', 'admin')} || l_partkey || ' (HTTP ' || (['200', '403', '404'])[l_linenumber % 3 + 1] || ')'",
         "CASE WHEN l_returnflag = 'A' THEN 'INFO' WHEN l_linenumber % 3 = 0 THEN 'HIGH' ELSE 'LOW' END", "'http://g'"), "l_linenumber % 3 < 2")
_format("prs10_credentials", tools.hydra_text, _f("[%s][%s] host: 10.0.0.%s   login: u%s   password: no-%s-word", _ln, _flag("ssh", "ftp", "rdp"), _sk, _pk, _pk), "# Hydra\n", "\n", "\n",
        ("'Valid credentials recovered by brute force: ' || " + _sql_flag("ssh", "ftp", "rdp") + " || ' u' || l_partkey || '@10.0.0.' || l_suppkey || ':' || l_linenumber", "'CRITICAL'", "'10.0.0.' || l_suppkey || ':' || l_linenumber"))
_format("prs11_bandit", scans.bandit, _f('{"test_id":"B%s","test_name":"t","issue_severity":"%s","issue_text":"x","filename":"f%s.py","line_number":%s}', _pk, _flag("HIGH", "LOW", "UNDEFINED"), _sk, _ln), '{"results":[', "]}", ",",
        ("'t (B' || l_partkey || ')'", _sql_flag("HIGH", "LOW", "INFO"), "'f' || l_suppkey || '.py:' || l_linenumber"))
_format("prs11_semgrep", tools.semgrep, _f('{"check_id":"c%s","path":"f%s.py","start":{"line":%s},"extra":{"message":"Bad call %s. More","severity":"%s"}}', _pk, _sk, _ln, _pk, _flag("ERROR", "WARNING", "INFO")), '{"results":[', "]}", ",",
        ("'Bad call ' || l_partkey", _sql_flag("HIGH", "MEDIUM", "INFO"), "'f' || l_suppkey || '.py:' || l_linenumber"))
_format("prs12_pentest_table", tools.pentest_csv, _f("%s,Flaw %s,%s risk,10.0.0.%s,fix it", _ln, _pk, _flag("High", "Low", "Medium"), _sk), "Report of a test\nS No,Vulnerability,Severity,Host,Recommendation\n", "", "\n",
        ("'Flaw ' || l_partkey", _sql_flag("HIGH", "LOW", "MEDIUM"), "'10.0.0.' || l_suppkey"))


@query("prs02_nmap", f"SELECT DISTINCT {_BASE}, 'Nmap: Cleartext Remote Login Service (Telnet) (' || l_linenumber || '/tcp)' AS title, 'HIGH' AS severity, '10.0.0.' || l_suppkey AS target FROM lineitem WHERE l_returnflag = 'R'")
def _(t: Tables) -> DataFrame:
    line = _f("Nmap scan report for 10.0.0.%s\n%s/tcp open %s x", _sk, _ln, _flag("telnet", "http", "http"))
    return tools.nmap_text(exported(t, content(line, "Starting Nmap\n", "\n", "\n"))).select("file", "title", "severity", "target").distinct()


@query("txt25_tool_segments", f"SELECT {_BASE}, count(*) FILTER (l_returnflag = 'R') AS nmap, count(*) FILTER (l_returnflag <> 'R') AS hydra FROM lineitem GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """Console output of several tools in one file, cut at their banners."""
    line = _f("%s %s\nsome line %s", _flag("Nmap scan report for", "# Hydra v9", "# Hydra v9"), _sk, _pk)
    parts = tools.segments(exported(t, content(line, "noise first\n", "", "\n"))).filter("tool IS NOT NULL")
    return parts.groupBy("file").agg(F.count_if(F.col("tool") == "nmap").alias("nmap"), F.count_if(F.col("tool") == "hydra").alias("hydra"))


@query("prs00_dispatch", """SELECT tool AS source_tool, count(*) AS n FROM lineitem, (VALUES ('Qualys'), ('OpenVAS'), ('Lint')) AS tools(tool) GROUP BY tool
  UNION ALL SELECT 'Nessus', count(DISTINCT (l_orderkey, l_partkey, l_suppkey, l_linenumber)) FROM lineitem UNION ALL SELECT 'Nuclei', count(DISTINCT (l_orderkey, l_partkey, l_linenumber)) FROM lineitem""")
def _(t: Tables) -> DataFrame:
    files = exported(t, nessus_file(), qualys_file(), openvas_file(), nuclei_file(), sarif_file())
    return scans.read(files).groupBy("source_tool").agg(F.count("*").alias("n"))


# Documents

_ROWS = "SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 AS i, l_orderkey || '  ' || l_linenumber || '  p,' || l_partkey AS x, 'order=' || l_orderkey || ' | line=' || l_linenumber || ' | part=p,' || l_partkey AS y FROM lineitem"


def _windows(n: int, shared: int, before: str, value: str) -> str:
    step = n - shared
    return f"WITH r AS ({_ROWS}), k AS (SELECT DISTINCT l_suppkey, i // {step} AS chunk FROM r) SELECT k.l_suppkey::VARCHAR AS file, k.chunk::INT AS chunk_index, md5({before} || string_agg({value}, chr(10) ORDER BY i)) AS digest FROM k JOIN r ON r.l_suppkey = k.l_suppkey AND i >= chunk * {step} AND i < chunk * {step} + {n} GROUP BY k.l_suppkey, k.chunk"


def _tables(t: Tables) -> DataFrame:
    """One table as CSV for each supplier, its rows in order."""
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    rows = t("lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_list(key)).alias("r"))
    line = lambda x: F.format_string('%s,%s,"p,%s"', x["l_orderkey"], x["l_linenumber"], x["l_partkey"])
    return rows.select(F.col("l_suppkey").cast("string").alias("file"), F.concat(F.lit("order,line,part\n"), F.array_join(F.transform("r", line), "\n")).alias("text"))


@query("src01e_csv_chunks", _windows(15, 3, "'Headers: order  line  part' || chr(10)", "x"))
def _(t: Tables) -> DataFrame:
    return documents.row_chunks(_tables(t), ["file"], "text", False).select("file", "chunk_index", F.md5("content").alias("digest"))


@query("src01d_sheet_chunks", _windows(5, 1, "''", "y"))
def _(t: Tables) -> DataFrame:
    return documents.row_chunks(_tables(t), ["file"], "text", True).select("file", "chunk_index", F.md5("content").alias("digest"))


def _files(t: Tables) -> DataFrame:
    """(file, data): documents as text files, tables of suppliers as CSV, nations as documents of tags."""
    text = t("documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"), F.coalesce("text", F.lit("")).alias("x"))
    csv = _tables(t).select(F.concat(F.lit("table"), "file", F.lit(".csv")).alias("file"), F.col("text").alias("x"))
    xml = t("nation").select(F.concat(F.lit("nation"), F.col("n_nationkey").cast("string"), F.lit(".xml")).alias("file"), F.format_string("<nation><name>%s</name><region>%s</region></nation>", "n_name", "n_regionkey").alias("x"))
    return text.unionByName(csv).unionByName(xml).select("file", F.col("x").cast("binary").alias("data"))


_FILES = """SELECT doc_id || '.txt' AS file, 'text' AS kind, coalesce(text, '') AS x FROM documents
UNION ALL SELECT 'table' || l_suppkey || '.csv', 'table', 'order,line,part' || chr(10) || string_agg(l_orderkey || ',' || l_linenumber || ',"p,' || l_partkey || '"', chr(10) ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) FROM lineitem GROUP BY l_suppkey
UNION ALL SELECT 'nation' || n_nationkey || '.xml', 'xml', 'name: ' || n_name || chr(10) || 'region: ' || n_regionkey || chr(10) || chr(10) || '[RAW XML]' || chr(10) || '<nation><name>' || n_name || '</name><region>' || n_regionkey || '</region></nation>' FROM nation"""


@query("src01_parts", f"SELECT file, file AS part, kind, md5(x) AS digest FROM ({_FILES})")
def _(t: Tables) -> DataFrame:
    """Files of several kinds: what each holds, and its text."""
    p = documents.parts(_files(t))
    return p.select("file", "part", "kind", F.md5(documents.text_of(F.col("kind"), F.col("data"))).alias("digest"))


@query("src01_documents", None)
def _(t: Tables) -> DataFrame:
    """Files of several kinds: opened, decoded and cut into chunks. Cuts depend on those before, so there is no SQL."""
    return documents.chunks(documents.parts(_files(t))).select("file", "chunk_index", "source_type", F.md5("content").alias("digest"))


@query("src11_guardrail", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'executable' WHEN page_id % 3 = 1 THEN 'signature' END AS flaw FROM pages")
def _(t: Tables) -> DataFrame:
    """Pages as files whose first bytes are those of a program, of another format than the name says, or their own."""
    head = F.when(F.col("page_id") % 3 == 0, F.unhex(F.lit("4D5A90"))).when(F.col("page_id") % 3 == 1, F.unhex(F.lit("504B0304"))).otherwise(F.unhex(F.lit("25504446")))
    files = t("pages").select("page_id", F.lit("a.pdf").alias("file"), F.concat(head, F.col("html").cast("binary")).alias("data"))
    return documents.guarded(files).select("page_id", "flaw")
