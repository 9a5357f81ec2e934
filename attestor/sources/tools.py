"""Readers of console tools, web scanners and XML exports, to the findings of `scans`.

Each reader takes rows (file, content) of its own format and reads nothing else from them; DataFrame functions only. Passwords
that a tool recovered are never part of a finding. A file's findings are made in one task and are bounded by its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import severity as S
from .scans import FIVE, RISKY, _filled, _finding, _level, _number, _stated, _sure, cves, cwes, records

_c = F.col
# Severities and confidence by the codes of one scanner; paths whose exposure is a finding; the port of each
# risky service; weak ciphers by their parts; names of flaws that are dangerous without a number.
ZAP_RISK = {"3": "HIGH", "2": "MEDIUM", "1": "LOW", "0": "INFO"}
ZAP_SURE = {"1": "Tentative", "2": "Firm", "3": "Certain", "4": "Certain"}
SENSITIVE = (
    ".git", ".svn", ".env", ".bak", ".old", ".sql", ".zip", ".tar", "backup", "dump", "config", "wp-config", "id_rsa", ".ssh", "admin", "phpmyadmin", ".htpasswd",
    "server-status", "server-info", "phpinfo", ".ds_store", "web.config", ".htaccess",
)
ANSWERS = ("200", "201", "204", "301", "302", "307", "401", "403", "500")
RISKY_PORTS = {"23": "telnet", "513": "login", "514": "shell", "512": "exec"}
WEAK = ("RC4", "DES", "3DES", "NULL", "EXP", "EXPORT", "ADH", "AECDH", "ANON", "MD5", "IDEA")
DANGEROUS = r"(?i)remote code execution|\brce\b|file upload|sql injection|authentication bypass|privilege escalation"
NAMED_CRITICAL = ("backdoor", "bluekeep", "eternalblue", "shellshock", "log4shell", "remote code execution", "wormable")
NAMED_HIGH = ("path traversal", "directory traversal", "heartbleed", "sql injection", "authentication bypass")


def _part(pattern: str, i: int = 1, of: str | Column = "content") -> Column:
    return _filled(F.regexp_extract(of if isinstance(of, Column) else F.col(of), pattern, i))


def _lines(docs: DataFrame, pattern: str) -> DataFrame:
    """(file, content, at, line): the lines that a pattern matches from their start."""
    return docs.select("file", "content", F.posexplode(F.regexp_extract_all("content", F.lit(rf"(?m)^{pattern}.*$"), F.lit(0))).alias("at", "line"))


def plain(html: Column) -> Column:
    """Text of a fragment of HTML."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?i)</p>\s*<p>|<br\s*/?>", "\n")
    t = F.regexp_replace(t, "<[^>]+>", "")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(t, r"[ \t]+", " "))


def _xml(docs: DataFrame, schema: str) -> DataFrame:
    """(file, d): documents without their type declaration."""
    bare = F.regexp_replace("content", r"(?s)<!DOCTYPE[^>\[]*(?:\[.*?\])?\s*>", "")
    return docs.select("file", F.from_xml(bare, schema).alias("d"))


def _json(docs: DataFrame, schema: str) -> DataFrame:
    return docs.select("file", F.from_json("content", schema).alias("d"))


# Web scanners

_ALERT = "pluginid:string,alert:string,name:string,riskcode:string,confidence:string,desc:string,solution:string,otherinfo:string,cweid:string"
_INSTANCE = "struct<uri:string,method:string,param:string,attack:string,evidence:string>"


def _alerts(rows: DataFrame) -> DataFrame:
    """One finding for each alert of a site; its place is that of its only instance, or the site."""
    a = F.col("a")
    place = lambda x: F.concat(x["uri"], F.when(F.coalesce(x["param"], F.lit("")) != "", F.concat(F.lit(" ["), x["param"], F.lit("]"))).otherwise(""))
    places = F.array_distinct(F.filter(F.transform(F.coalesce("i", F.array().cast(f"array<{_INSTANCE}>")), place), lambda p: p.isNotNull() & (p != "")))
    said = F.array_join(F.transform(F.slice(F.coalesce("i", F.array().cast(f"array<{_INSTANCE}>")), 1, 10), lambda x: F.concat_ws(" ", x["method"], x["uri"], _filled(x["evidence"]))), "\n")
    weak = F.when(a["cweid"].rlike("^[1-9][0-9]*$"), F.array(F.concat(F.lit("CWE-"), a["cweid"])))
    title = F.coalesce(_filled(a["alert"]), _filled(a["name"]), F.lit("ZAP alert"))
    return _finding(
        rows, "OWASP ZAP", plugin_id=a["pluginid"], title=title, severity=S.lookup(F.trim(a["riskcode"]), ZAP_RISK, "INFO"), confidence=S.lookup(F.trim(a["confidence"]), ZAP_SURE, "Firm"),
        cve_list=weak, target=F.when(F.size(places) == 1, places[0]).otherwise(_c("site")), description=F.concat_ws("\n\n", _filled(plain(a["desc"])), _filled(plain(a["otherinfo"]))),
        remediation=plain(a["solution"]), evidence=F.coalesce(_filled(said), title),
    )


def zap_json(docs: DataFrame) -> DataFrame:
    rows = _json(docs, f"struct<site:array<struct<`@name`:string,`@host`:string,alerts:array<struct<{_ALERT},instances:array<{_INSTANCE}>>>>>>").select("file", F.explode("d.site").alias("s"))
    rows = rows.select("file", F.coalesce(_c("s.`@name`"), _c("s.`@host`")).alias("site"), F.explode("s.alerts").alias("a"))
    return _alerts(rows.withColumn("i", _c("a.instances")))


def zap_xml(docs: DataFrame) -> DataFrame:
    rows = _xml(docs, f"site array<struct<_name:string,_host:string,alerts:struct<alertitem:array<struct<{_ALERT},instances:struct<instance:array<{_INSTANCE}>>>>>>>").select("file", F.explode("d.site").alias("s"))
    rows = rows.select("file", F.coalesce("s._name", "s._host").alias("site"), F.explode("s.alerts.alertitem").alias("a"))
    return _alerts(rows.withColumn("i", _c("a.instances.instance")))


def burp_xml(docs: DataFrame) -> DataFrame:
    """The scanner gives no scores; classes of weakness stand in the classifications."""
    issue = "name:string,host:string,path:string,location:string,severity:string,confidence:string,issueBackground:string,issueDetail:string,remediationBackground:string,remediationDetail:string,vulnerabilityClassifications:string,type:string"
    issue = issue.replace("host:string", "host:struct<_VALUE:string,_ip:string>")
    rows = _xml(docs, f"issue array<struct<{issue}>>").select("file", F.explode("d.issue").alias("i"))
    i = F.col("i")
    where = F.concat_ws("", i["host"]["_VALUE"], i["path"])
    return _finding(
        rows, "Burp Suite", plugin_id=i["type"], title=F.coalesce(_filled(i["name"]), F.lit("Burp Suite Finding")), severity=S.normalised(i["severity"]), confidence=F.coalesce(_filled(i["confidence"]), F.lit("Firm")),
        cve_list=F.concat(cves(F.concat_ws(" ", i["issueDetail"], i["vulnerabilityClassifications"])), cwes(i["vulnerabilityClassifications"])),
        target=F.when(_filled(i["location"]).isNotNull(), F.concat(where, F.lit(" ("), i["location"], F.lit(")"))).otherwise(where),
        description=plain(F.concat_ws("\n\n", i["issueDetail"], i["issueBackground"])), remediation=plain(F.concat_ws("\n\n", i["remediationDetail"], i["remediationBackground"])), evidence=plain(F.coalesce(i["issueDetail"], i["name"])),
    )


def _nikto(rows: DataFrame) -> DataFrame:
    """Findings of (site, uri, msg). The severity is what the message says, whatever its reference."""
    said = F.when((F.coalesce("uri", F.lit("")) == "") | F.col("msg").startswith(F.concat("uri", F.lit(":"))), F.col("msg")).otherwise(F.concat_ws(": ", "uri", "msg"))
    low = F.lower(said)
    sev = F.when(low.rlike("outdated|appears to be out of date|directory indexing|index of"), "MEDIUM").when(low.contains("may cause false positives"), "INFO").otherwise("LOW")
    rows = rows.withColumn("said", said).filter((F.length("said") >= 12) & ~F.col("said").rlike(r"(?i)^(?:Target |Start Time|End Time|Server:|SSL Info|[0-9]+ (?:host|request)|No CGI|Root page|Scan terminated)|item\(s\) reported"))
    return _finding(rows, "Nikto", title=F.concat(F.lit("Nikto: "), F.left("said", F.lit(110))), severity=sev, target=_c("site"), description=_c("said"), evidence=_c("said"))


def _site(host: Column, port: Column) -> Column:
    return F.when(port.isin("80", "443") | port.isNull(), host).otherwise(F.concat_ws(":", host, port))


def nikto_csv(docs: DataFrame) -> DataFrame:
    """Rows of host, address, port, reference, method, path and message."""
    rows = docs.select("file", F.explode(F.regexp_extract_all("content", F.lit(r'(?m)^"[^"\r\n]*"(?:,"[^"\r\n]*"){6}'), F.lit(0))).alias("line"))
    field = lambda i: F.regexp_extract("line", r'^"([^"]*)"' + r',"([^"]*)"' * 6, i + 1)
    return _nikto(rows.select("file", _site(field(0), field(2)).alias("site"), field(5).alias("uri"), field(6).alias("msg")).filter("msg <> ''"))


def nikto_json(docs: DataFrame) -> DataFrame:
    one = "struct<host:string,ip:string,port:string,vulnerabilities:array<struct<id:string,url:string,msg:string>>>"
    many = F.coalesce(F.from_json("content", f"array<{one}>"), F.array(F.from_json("content", one)))
    rows = docs.select("file", F.explode(many).alias("h")).select("file", _site(F.coalesce("h.host", "h.ip"), _c("h.port")).alias("site"), F.explode("h.vulnerabilities").alias("v"))
    return _nikto(rows.select("file", "site", _c("v.url").alias("uri"), _c("v.msg").alias("msg")))


def nikto_xml(docs: DataFrame) -> DataFrame:
    rows = _xml(docs, "scandetails array<struct<_targethostname:string,_targetip:string,_targetport:string,item:array<struct<_id:string,description:string,uri:string>>>>").select("file", F.explode("d.scandetails").alias("s"))
    rows = rows.select("file", _site(F.coalesce(_filled(_c("s._targethostname")), _c("s._targetip")), _c("s._targetport")).alias("site"), F.explode("s.item").alias("i"))
    return _nikto(rows.select("file", "site", F.trim("i.uri").alias("uri"), F.trim("i.description").alias("msg")))


def nikto_text(docs: DataFrame) -> DataFrame:
    host = F.coalesce(_part(r"(?m)^\+ Target Hostname:\s+(\S+)"), _part(r"(?m)^\+ Target IP:\s+(\S+)"), F.lit("Target Host"))
    rows = _lines(docs, r"\+ ").select("file", host.alias("site"), F.lit("").alias("uri"), F.trim(F.substring("line", 3, 10_000)).alias("msg"))
    return _nikto(rows)


def _injected(rows: DataFrame, param: Column, method: Column, detail: Column, target: Column) -> DataFrame:
    title = F.format_string("SQL Injection confirmed in %s parameter '%s' (%s)", method, param, F.left(detail, F.lit(60)))
    return _finding(rows, "sqlmap", title=title, severity=F.lit("CRITICAL"), target=target, description=title, evidence=detail)


def sqlmap_csv(docs: DataFrame) -> DataFrame:
    rows = records(docs, lambda x: x.startswith("target url,place,parameter"), url=("target url",), place=("place",), param=("parameter",), how=("technique(s)",))
    return _injected(rows.filter(F.col("param").isNotNull()), F.col("param"), F.col("place"), F.coalesce("how", F.lit("confirmed")), F.col("url"))


def sqlmap_text(docs: DataFrame) -> DataFrame:
    """The parameters that were found injectable, each with the kinds of its payloads."""
    blocks = docs.select("file", "content", F.explode(F.slice(F.split("content", r"(?m)^Parameter: "), 2, 10_000)).alias("b"))
    kinds = F.array_join(F.array_distinct(F.regexp_extract_all("b", F.lit(r"(?m)^\s+Type: (.+)$"), F.lit(1))), ", ")
    target = F.coalesce(_part(r"(?m)^URL: (\S+)"), _part(r"(?i)testing URL '([^']+)'"), F.lit("Target Host"))
    return _injected(blocks, F.regexp_extract("b", r"^(\S+)", 1), F.coalesce(_filled(F.regexp_extract("b", r"^\S+ \(([^)]+)\)", 1)), F.lit("GET")), F.coalesce(_filled(kinds), F.lit("confirmed")), target)


def _paths(rows: DataFrame, tool: str) -> DataFrame:
    """Findings of (path, code, site): what a list of answering paths tells. Only sensitive paths are rated."""
    rows = rows.filter(F.col("code").isin(*ANSWERS)).withColumn("path", F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit("/"), "path")))
    low = F.lower("path")
    hot = low.contains(SENSITIVE[0])
    for s in SENSITIVE[1:]:
        hot = hot | low.contains(s)
    sev = F.when(~hot, "INFO").when(_c("code").isin("200", "201", "204"), "HIGH").when(_c("code").isin("301", "302", "307", "500"), "MEDIUM").otherwise("LOW")
    title = F.concat(F.when(hot, "Exposed path discovered: ").otherwise("Discovered path: "), "path", F.lit(" (HTTP "), "code", F.lit(")"))
    return _finding(rows, tool, title=title, severity=sev, target=F.coalesce("site", F.lit("Target Host")), description=title, evidence=_c("line"))


def gobuster(docs: DataFrame) -> DataFrame:
    site = F.coalesce(_part(r"(?im)^\[\+\] Url(?:/Domain)?\s*:\s*(\S+)"), _part(r"--> (https?://[^/\s\]]+)"))
    rows = _lines(docs, r"/\S*\s+\(Status: [0-9]{3}\)")
    return _paths(rows.select("file", "line", site.alias("site"), _part(r"^(/\S*)", of="line").alias("path"), _part(r"Status: ([0-9]{3})", of="line").alias("code")), "Gobuster")


def dirb(docs: DataFrame) -> DataFrame:
    """Found files have a code; directories answer with a redirection."""
    site = F.coalesce(_part(r"(?m)^URL_BASE:\s*(\S+)"), F.lit("Target Host"))
    rows = _lines(docs, r"(?:\+ https?://\S+ \(CODE:[0-9]{3}|==> DIRECTORY: https?://)")
    url = _part(r"(https?://\S+)", of="line")
    return _paths(rows.select("file", "line", site.alias("site"), F.regexp_replace(url, "^https?://[^/]+", "").alias("path"), F.coalesce(_part(r"CODE:([0-9]{3})", of="line"), F.lit("301")).alias("code")), "DIRB")


def ffuf_text(docs: DataFrame) -> DataFrame:
    site = F.regexp_replace(_part(r"(?m)^\s*:: URL\s*:\s*(\S+)"), "FUZZ$", "")
    rows = _lines(docs, r"\S+\s+\[Status: [0-9]{3},")
    return _paths(rows.select("file", "line", site.alias("site"), _part(r"^(\S+)", of="line").alias("path"), _part(r"Status: ([0-9]{3})", of="line").alias("code")), "ffuf")


def ffuf_json(docs: DataFrame) -> DataFrame:
    rows = _json(docs, "struct<results:array<struct<input:struct<FUZZ:string>,status:string,url:string,host:string>>,config:struct<url:string>>").select("file", _c("d.config.url").alias("base"), F.explode("d.results").alias("r"))
    rows = rows.select("file", F.concat_ws(" ", "r.url", "r.status").alias("line"), F.regexp_replace("base", "FUZZ$", "").alias("site"), F.coalesce("r.input.FUZZ", F.regexp_replace("r.url", "^https?://[^/]+", "")).alias("path"), _c("r.status").alias("code"))
    return _paths(rows, "ffuf")


def feroxbuster(docs: DataFrame) -> DataFrame:
    rows = _lines(docs, r"[0-9]{3}\s+[A-Z]+\s+[0-9]+l\s+[0-9]+w\s+[0-9]+c\s+https?://")
    url = _part(r"(https?://\S+)", of="line")
    return _paths(rows.select("file", "line", F.regexp_extract(url, r"^(https?://[^/]+)", 1).alias("site"), F.regexp_replace(url, "^https?://[^/]+", "").alias("path"), _part("^([0-9]{3})", of="line").alias("code")), "Feroxbuster")


_WP = "struct<title:string,fixed_in:string,references:struct<cve:array<string>>>"
_WP_PART = f"struct<slug:string,latest_version:string,outdated:boolean,version:struct<number:string>,vulnerabilities:array<{_WP}>>"


def wpscan(docs: DataFrame) -> DataFrame:
    """Published flaws of the core, theme and plugins, parts that are out of date, names of users, and what else was noted."""
    schema = f"struct<target_url:string,effective_url:string,interesting_findings:array<struct<to_s:string,type:string>>,version:struct<number:string,status:string,vulnerabilities:array<{_WP}>>,main_theme:{_WP_PART},plugins:map<string,{_WP_PART}>,users:map<string,struct<slug:string>>>"
    d = _json(docs, schema)
    text, none = "struct<title:string,severity:string,cves:array<string>,note:string>", F.array().cast("array<string>")
    one = lambda title, sev, ids, note: F.struct(title.alias("title"), (sev if isinstance(sev, Column) else F.lit(sev)).alias("severity"), ids.alias("cves"), note.alias("note"))
    empty = F.array().cast(f"array<{text}>")
    ids = lambda v: F.transform(F.coalesce(v["references"]["cve"], none), lambda c: F.concat(F.lit("CVE-"), c))
    flaw = lambda v: one(F.concat(F.lit("WordPress vulnerability: "), F.left(v["title"], F.lit(100))), F.when((F.size(ids(v)) > 0) | v["title"].rlike(DANGEROUS), "HIGH").otherwise("MEDIUM"), ids(v), F.concat(F.lit("Fixed in "), v["fixed_in"]))
    flaws = lambda v: F.coalesce(F.transform(v, flaw), empty)
    old = lambda p, kind: F.when(p["outdated"], F.array(one(F.concat(F.lit(f"Outdated WordPress {kind}: "), p["slug"], F.coalesce(F.concat(F.lit(" "), p["version"]["number"]), F.lit(""))), "LOW", none, F.concat(F.lit("Latest: "), p["latest_version"])))).otherwise(empty)
    plugins = F.coalesce(F.map_values("d.plugins"), F.array().cast(f"array<{_WP_PART}>"))
    core = F.when(_c("d.version.status") == "insecure", F.array(one(F.concat(F.lit("Insecure WordPress version "), "d.version.number"), "MEDIUM", none, F.lit("")))).otherwise(empty)
    noted = F.coalesce(F.transform("d.interesting_findings", lambda x: one(x["to_s"], F.when(x["type"] == "xmlrpc", "LOW").otherwise("INFO"), none, x["type"])), empty)
    users = F.coalesce(F.transform(F.map_keys("d.users"), lambda u: one(F.concat(F.lit("WordPress user enumerated: "), u), "LOW", none, F.lit(""))), empty)
    everything = F.flatten(F.array(noted, core, flaws(_c("d.version.vulnerabilities")), F.coalesce(old(_c("d.main_theme"), "theme"), empty), flaws(_c("d.main_theme.vulnerabilities")), F.flatten(F.transform(plugins, lambda p: F.concat(old(p, "plugin"), flaws(p["vulnerabilities"])))), users))
    rows = d.select("file", F.coalesce("d.effective_url", "d.target_url").alias("site"), F.explode(everything).alias("x")).filter("x.title IS NOT NULL")
    return _finding(rows, "WPScan", title=_c("x.title"), severity=_c("x.severity"), cve_list=_c("x.cves"), target=_c("site"), description=_c("x.title"), remediation=_filled(_c("x.note")), evidence=_c("x.title"))


# Credentials and hosts


def _recovered(rows: DataFrame, tool: str) -> DataFrame:
    """Findings of (service, host, port, login). The password isn't among their columns."""
    where = F.concat_ws(":", "host", "port")
    title = F.format_string("Valid credentials recovered by brute force: %s %s@%s", "service", "login", where)
    return _finding(rows, tool, title=title, severity=F.lit("CRITICAL"), target=where, description=title, evidence=F.concat_ws(" ", "service", "host", "login"))


def hydra_text(docs: DataFrame) -> DataFrame:
    rows = _lines(docs, r"\[[0-9]+\]\[[^\]]+\] host: ")
    f = lambda p: _part(p, of="line")
    return _recovered(rows.select("file", f(r"^\[[0-9]+\]\[([^\]]+)\]").alias("service"), f(r"host: (\S+)").alias("host"), f(r"^\[([0-9]+)\]").alias("port"), F.coalesce(f(r"login: (\S+)"), F.lit("")).alias("login")), "Hydra")


def hydra_json(docs: DataFrame) -> DataFrame:
    rows = _json(docs, "struct<results:array<struct<port:string,service:string,host:string,login:string>>>").select("file", F.explode("d.results").alias("r"))
    return _recovered(rows.select("file", "r.service", "r.host", "r.port", F.coalesce("r.login", F.lit("")).alias("login")), "Hydra")


def medusa(docs: DataFrame) -> DataFrame:
    rows = _lines(docs, r"ACCOUNT FOUND: ")
    f = lambda p: _part(p, of="line")
    return _recovered(rows.select("file", f(r"\[([^\]]+)\] Host:").alias("service"), f(r"Host: (\S+)").alias("host"), F.lit(None).cast("string").alias("port"), F.coalesce(f(r"User: (\S+)"), F.lit("")).alias("login")), "Medusa")


def masscan(docs: DataFrame) -> DataFrame:
    """One finding for each risky port, and the inventory of each host."""
    rows = _lines(docs, r"(?:Discovered open port [0-9]+/|open (?:tcp|udp) [0-9]+ )")
    one = rows.select(
        "file", F.coalesce(_part(r"port ([0-9]+)/", of="line"), _part(r"^open \S+ ([0-9]+)", of="line")).alias("port"), F.coalesce(_part(r"/(tcp|udp) on", of="line"), _part(r"^open (tcp|udp)", of="line")).alias("proto"),
        F.coalesce(_part(r" on (\S+)", of="line"), _part(r"^open \S+ [0-9]+ (\S+)", of="line")).alias("host"),
    ).distinct()
    label = S.lookup(S.lookup(F.col("port"), RISKY_PORTS), RISKY)
    risky = one.filter((F.col("proto") == "tcp") & F.col("port").isin(*RISKY_PORTS))
    rated = _finding(risky, "masscan", title=F.format_string("%s (%s/tcp)", label, "port"), severity=F.lit("HIGH"), target=_c("host"), confidence=F.lit("Tentative"), description=label, evidence=F.concat_ws("/", "port", "proto"))
    ports = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("proto", F.col("port").cast("int").alias("n")))), lambda p: F.concat_ws("/", p["n"].cast("string"), p["proto"])), ", ")
    hosts = one.groupBy("file", "host").agg(ports.alias("ports"))
    title = F.format_string("Open ports on %s: %s", "host", "ports")
    return rated.unionByName(_finding(hosts, "masscan", title=title, severity=F.lit("INFO"), target=_c("host"), description=title, evidence=_c("ports")))


def enum4linux(docs: DataFrame) -> DataFrame:
    """Null sessions, open shares, names of users, and weak rules for passwords."""
    target = F.coalesce(_part(r"(?m)^Target \.+ (\S+)"), _part(r"(?:Session Check|Target Information) on (\S+)"), F.lit("Target Host"))
    none = F.array().cast("array<struct<title:string,severity:string>>")
    some = lambda when, title, sev: F.when(when, F.array(F.struct((title if isinstance(title, Column) else F.lit(title)).alias("title"), F.lit(sev).alias("severity")))).otherwise(none)
    c = F.col("content")
    shares = F.regexp_extract_all(c, F.lit(r"(?m)^//[^/\s]+/\S+\s+Mapping: OK,? Listing: OK.*$"), F.lit(0))
    name = lambda s: F.regexp_extract(s, r"^//[^/\s]+/(\S+)", 1)
    writes = lambda s: s.rlike("Writing: OK")
    opened = F.transform(F.filter(shares, lambda s: F.upper(name(s)) != "IPC$"), lambda s: F.struct(F.concat(F.lit("Anonymous "), F.when(writes(s), "write").otherwise("read"), F.lit(" access to SMB share '"), name(s), F.lit("'")).alias("title"), F.when(writes(s), "HIGH").otherwise("MEDIUM").alias("severity")))
    users = F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"user:\[([^\]]+)\]\s*rid:"), F.lit(1))))
    least = F.regexp_extract(c, r"Minimum password length:\s*([0-9]+)", 1).try_cast("int")
    found = F.flatten(F.array(
        some(c.rlike("allows sessions? using username '', password ''"), "SMB null session permitted", "MEDIUM"), opened, some(F.size(users) > 0, F.concat(F.lit("SMB user enumeration: "), F.array_join(F.slice(users, 1, 10), ", ")), "LOW"),
        some(least < 8, F.concat(F.lit("Weak domain password policy: minimum length "), least.cast("string")), "MEDIUM"), some(c.rlike(r"Account Lockout Threshold:\s*(?:None|0)\b"), "No account lockout threshold", "MEDIUM"),
    ))
    rows = docs.select("file", target.alias("host"), F.explode(found).alias("x"))
    return _finding(rows, "enum4linux", title=_c("x.title"), severity=_c("x.severity"), target=_c("host"), description=_c("x.title"), evidence=_c("x.title"))


# Networks


def _service_findings(rows: DataFrame) -> DataFrame:
    """Findings of (target, port, proto, service, shown) for open ports of risky services."""
    at = F.concat_ws("/", "port", "proto")
    risky = rows.filter(F.lower("service").isin(*RISKY))
    return _finding(risky, "Nmap", title=F.format_string("Nmap: %s (%s)", S.lookup(F.lower("service"), RISKY), at), severity=F.lit("HIGH"), target=_c("target"), description=_c("shown"), evidence=_c("shown"))


def _named(text: Column, cve: Column) -> Column:
    """Severity of a flaw that has a name but no number."""
    low = F.lower(text)
    any_of = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: low.contains(w))
    return F.when(any_of(NAMED_CRITICAL), "CRITICAL").when(any_of(NAMED_HIGH), "HIGH").when(cve, "MEDIUM").otherwise("INFO")


def nmap_xml(docs: DataFrame) -> DataFrame:
    """Risky services, and scripts that name a CVE or say VULNERABLE."""
    port = "struct<_protocol:string,_portid:string,state:struct<_state:string>,service:struct<_name:string,_product:string,_version:string>,script:array<struct<_id:string,_output:string>>>"
    rows = _xml(docs, f"host array<struct<address:array<struct<_addr:string,_addrtype:string>>,hostnames:struct<hostname:array<struct<_name:string>>>,ports:struct<port:array<{port}>>>>").select("file", F.explode("d.host").alias("h"))
    ip = F.get(F.filter("h.address", lambda a: a["_addrtype"] != "mac"), F.lit(0))["_addr"]
    name = F.get(_c("h.hostnames.hostname"), F.lit(0))["_name"]
    rows = rows.select("file", F.when(name.isNotNull(), F.format_string("%s (%s)", name, ip)).otherwise(ip).alias("target"), F.explode("h.ports.port").alias("p")).filter("p.state._state = 'open'")
    shown = F.concat_ws(" ", F.concat_ws("/", "p._portid", "p._protocol"), F.lit("open"), "p.service._name", "p.service._product", "p.service._version")
    rows = rows.select("file", "target", _c("p._portid").alias("port"), _c("p._protocol").alias("proto"), _c("p.service._name").alias("service"), shown.alias("shown"), _c("p.script").alias("scripts"))
    scripts = rows.select("file", "target", "port", "proto", F.explode("scripts").alias("s")).filter(F.col("s._output").rlike(r"(?i)CVE-[0-9]{4}-|(?<!NOT )VULNERABLE"))
    ids = cves(_c("s._output"))
    flaws = _finding(scripts, "Nmap", plugin_id=_c("s._id"), title=F.format_string("Nmap: %s (%s/%s)", _c("s._id"), "port", "proto"), severity=_named(_c("s._output"), F.lit(True)), cve_list=ids, target=_c("target"), description=_c("s._output"), evidence=_c("s._output"))
    return _service_findings(rows).unionByName(flaws)


def nmap_text(docs: DataFrame) -> DataFrame:
    """Sections of hosts with lines of ports."""
    hosts = docs.select("file", F.explode(F.slice(F.split("content", r"(?m)^Nmap scan report for "), 2, 1_000_000)).alias("b"))
    target = F.regexp_extract("b", r"^([^\r\n]+)", 1)
    rows = hosts.select("file", F.trim(target).alias("target"), F.explode(F.regexp_extract_all("b", F.lit(r"(?m)^[0-9]+/(?:tcp|udp|sctp)\s+open\s+\S+.*$"), F.lit(0))).alias("line"))
    f = lambda p: _part(p, of="line")
    return _service_findings(rows.select("file", "target", f("^([0-9]+)/").alias("port"), f(r"/(\w+)").alias("proto"), f(r"open\s+(\S+)").alias("service"), F.trim("line").alias("shown")))


def openvas_xml(docs: DataFrame) -> DataFrame:
    result = """struct<name:string,host:struct<_VALUE:string,hostname:string>,port:string,nvt:struct<_oid:string,name:string,solution:struct<_VALUE:string>,refs:struct<ref:array<struct<_type:string,_id:string>>>>,
      threat:string,severity:string,qod:struct<value:string>,description:string>"""
    rows = _xml(docs, f"report struct<results:struct<result:array<{result}>>>,results struct<result:array<{result}>>").select("file", F.explode(F.coalesce("d.report.results.result", "d.results.result")).alias("r"))
    r, word, score = F.col("r"), F.lower(F.coalesce("r.threat", F.lit(""))), _number(_c("r.severity"))
    ip, host, port = F.trim(r["host"]["_VALUE"]), _filled(r["host"]["hostname"]), F.coalesce(r["port"], F.lit(""))
    label = F.when(host.isNotNull() & (host != ip), F.format_string("%s (%s)", host, ip)).otherwise(F.coalesce(host, ip, F.lit("Unknown Host")))
    ids = F.transform(F.filter(F.coalesce(r["nvt"]["refs"]["ref"], F.array().cast("array<struct<_type:string,_id:string>>")), lambda x: F.lower(x["_type"]) == "cve"), lambda x: F.upper(x["_id"]))
    return _finding(
        rows, "OpenVAS", plugin_id=r["nvt"]["_oid"], title=F.coalesce(r["name"], r["nvt"]["name"]), severity_score=score, confidence=_sure(r["qod"]["value"]), cve_list=F.array_sort(ids),
        severity=F.when(word.isin("critical", "high", "medium", "low"), F.upper(word)).when(word.isin("log", "debug", "none") | score.isNull(), "INFO").otherwise(S.band(score)),
        target=F.when((port != "") & ~port.startswith("general"), F.concat_ws(":", label, port)).otherwise(label), description=r["description"], remediation=r["nvt"]["solution"]["_VALUE"], evidence=r["description"],
    )


def qualys_xml(docs: DataFrame) -> DataFrame:
    """Rated flaws of each host; what only informs is INFO."""
    vuln = "struct<_number:string,_severity:string,TITLE:string,CVE_ID_LIST:struct<CVE_ID:array<struct<ID:string>>>,CVSS_BASE:string,CVSS3_BASE:string,DIAGNOSIS:string,CONSEQUENCE:string,SOLUTION:string,RESULT:string>"
    group = lambda name: f"struct<CAT:array<struct<_port:string,_protocol:string,{name}:array<{vuln}>>>>"
    hosts = _xml(docs, f"IP array<struct<_value:string,_name:string,VULNS:{group('VULN')},INFOS:{group('INFO')}>>").select("file", F.explode("d.IP").alias("h"))
    host = F.concat_ws(" / ", "h._value", "h._name").alias("host")
    bad = hosts.select("file", host, F.explode("h.VULNS.CAT").alias("c")).select("file", "host", _c("c._port").alias("port"), F.explode("c.VULN").alias("v"), F.lit(False).alias("info"))
    note = hosts.select("file", host, F.explode("h.INFOS.CAT").alias("c")).select("file", "host", _c("c._port").alias("port"), F.explode("c.INFO").alias("v"), F.lit(True).alias("info"))
    v = F.col("v")
    return _finding(
        bad.unionByName(note), "Qualys", plugin_id=v["_number"], title=F.coalesce(F.trim(v["TITLE"]), F.concat(F.lit("Qualys QID "), v["_number"])), severity=F.when(_c("info"), "INFO").otherwise(S.lookup(v["_severity"], FIVE, "INFO")),
        severity_score=F.coalesce(_number(v["CVSS3_BASE"]), _number(v["CVSS_BASE"])), cve_list=F.transform(v["CVE_ID_LIST"]["CVE_ID"], lambda x: F.upper(F.trim(x["ID"]))), target=F.concat_ws(":", "host", "port"),
        description=F.concat_ws("\n\n", F.trim(v["DIAGNOSIS"]), F.trim(v["CONSEQUENCE"])), remediation=F.trim(v["SOLUTION"]), evidence=F.coalesce(F.trim(v["RESULT"]), F.concat(F.lit("QID "), v["_number"])),
    )


# TLS


def _tls_records(rows: DataFrame) -> DataFrame:
    """Findings of (id, place, port, severity, finding, cve, cwe); only rated checks count."""
    rows = rows.filter(F.upper("severity").isin("LOW", "MEDIUM", "HIGH", "CRITICAL"))
    host, ip = F.split_part("place", F.lit("/"), F.lit(1)), F.split_part("place", F.lit("/"), F.lit(2))
    label = F.when((host != "") & (ip != "") & (host != ip), F.format_string("%s (%s)", host, ip)).otherwise(F.coalesce(_filled(host), _filled(ip), F.lit("Target Host")))
    return _finding(
        rows, "testssl.sh", plugin_id=_c("id"), title=F.left(F.concat_ws(": ", "id", "finding"), F.lit(160)), severity=F.upper("severity"), cve_list=F.concat(cves(_c("cve")), cwes(_c("cwe"))),
        target=F.concat_ws(":", label, _filled(_c("port"))), description=_c("finding"), evidence=F.concat_ws("  ", "id", F.upper("severity"), "finding"),
    )


def testssl_csv(docs: DataFrame) -> DataFrame:
    rows = records(docs, lambda x: x.startswith('"id","fqdn/ip"'), id=("id",), place=("fqdn/ip",), port=("port",), severity=("severity",), finding=("finding",), cve=("cve",), cwe=("cwe",))
    return _tls_records(rows.select("file", "id", F.coalesce("place", F.lit("")).alias("place"), "port", F.coalesce("severity", F.lit("")).alias("severity"), "finding", "cve", "cwe"))


def testssl_json(docs: DataFrame) -> DataFrame:
    one = "struct<id:string,ip:string,port:string,severity:string,finding:string,cve:string,cwe:string>"
    rows = docs.select("file", F.explode(F.from_json("content", f"array<{one}>")).alias("r"))
    return _tls_records(rows.select("file", "r.id", F.coalesce("r.ip", F.lit("")).alias("place"), "r.port", F.coalesce("r.severity", F.lit("")).alias("severity"), "r.finding", "r.cve", "r.cwe"))


def sslscan(docs: DataFrame) -> DataFrame:
    """Old protocols, weak ciphers, and flaws of the server and its certificate."""
    c = F.col("content")
    host, port, ip = _part(r"Testing SSL server (\S+) on port"), _part(r"Testing SSL server \S+ on port ([0-9]+)"), _part(r"Connected to (\S+)")
    label = F.when(host.isNotNull() & ip.isNotNull() & (host != ip), F.format_string("%s (%s)", host, ip)).otherwise(F.coalesce(host, ip, F.lit("Target Host")))
    none = F.array().cast("array<struct<title:string,severity:string,cves:array<string>>>")
    some = lambda when, title, sev, *ids: F.when(when, F.array(F.struct((title if isinstance(title, Column) else F.lit(title)).alias("title"), (sev if isinstance(sev, Column) else F.lit(sev)).alias("severity"), F.array(*map(F.lit, ids)).cast("array<string>").alias("cves")))).otherwise(none)
    old = F.regexp_extract_all(c, F.lit(r"(?m)^(SSLv2|SSLv3|TLSv1\.0|TLSv1\.1)\s+enabled"), F.lit(1))
    ciphers = F.regexp_extract_all(c, F.lit(r"(?m)^(?:Preferred|Accepted)\s+\S+\s+[0-9]+ bits\s+\S+"), F.lit(0))
    name = lambda x: F.regexp_extract(x, r"bits\s+(\S+)", 1)
    bits = lambda x: F.regexp_extract(x, r"([0-9]+) bits", 1).cast("int")
    weak = F.transform(F.filter(ciphers, lambda x: (bits(x) < 128) | F.arrays_overlap(F.split(F.upper(name(x)), "[^A-Z0-9]+"), F.array(*map(F.lit, WEAK)))), name)
    key, sign = F.regexp_extract(c, r"(?m)^RSA Key Strength:\s*([0-9]+)", 1).try_cast("int"), _part(r"(?im)^Signature Algorithm:\s*(\S*(?:md5|sha1)\S*)")
    found = F.flatten(F.array(
        some(F.size(old) > 0, F.concat(F.lit("Weak SSL/TLS Protocol Supported: "), F.array_join(old, ", ")), F.when(F.exists(old, lambda p: p.startswith("SSL")), "HIGH").otherwise("MEDIUM")),
        some(F.size(weak) > 0, F.concat(F.lit("Weak Cipher Suites Supported: "), F.array_join(F.slice(weak, 1, 5), ", ")), "MEDIUM"), some(c.rlike(r"(?m)^\S+ vulnerable to heartbleed"), "Heartbleed (CVE-2014-0160)", "CRITICAL", "CVE-2014-0160"),
        some(c.rlike("(?m)^Insecure session renegotiation supported"), "Insecure TLS renegotiation supported", "MEDIUM"), some(c.rlike("(?m)^Compression enabled"), "TLS compression enabled (CRIME)", "MEDIUM"),
        some(key < 2048, F.format_string("Weak certificate key: RSA %s bits", key.cast("string")), "MEDIUM"), some(sign.isNotNull(), F.concat(F.lit("Weak certificate signature: "), sign), "MEDIUM"),
    ))
    rows = docs.select("file", F.concat_ws(":", label, port).alias("target"), F.explode(found).alias("x"))
    return _finding(rows, "sslscan", title=_c("x.title"), severity=_c("x.severity"), cve_list=_c("x.cves"), target=_c("target"), description=_c("x.title"), evidence=_c("x.title"))


# Packages and code


def trivy_table(docs: DataFrame) -> DataFrame:
    """Rows between rules of a table; a title goes on over the lines of its row, and an empty library is that above it."""
    blocks = docs.select("file", F.coalesce(_part(r"(?m)^(\S[^\n]*)\n=+\s*$"), F.lit("Trivy scan target")).alias("target"), F.posexplode(F.split("content", r"(?m)^[┌├└][^\n]*$")).alias("at", "b"))
    lines = F.filter(F.split("b", "\n"), lambda x: x.startswith("│"))
    cells = lambda x: F.transform(F.split(x, "│"), lambda v: F.trim(v))
    rows = blocks.withColumn("cs", F.transform(lines, cells)).filter("size(cs) > 0")
    at = lambda i: F.get(F.get("cs", F.lit(0)), F.lit(i))
    title = F.trim(F.array_join(F.filter(F.transform("cs", lambda x: F.get(x, F.lit(7))), lambda v: v.isNotNull() & (v != "") & ~v.startswith("http")), " "))
    rows = rows.select("file", "target", "at", _filled(at(1)).alias("library"), at(2).alias("id"), at(3).alias("severity"), at(5).alias("installed"), at(6).alias("fixed"), title.alias("title"))
    above = F.last("library", True).over(W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("library", above).filter(F.col("id").rlike("^(?:CVE|GHSA|DLA|TEMP)-"))
    return _finding(rows, "Trivy", plugin_id=_c("id"), title=F.coalesce(_filled(_c("title")), "id"), severity=S.normalised(_c("severity")), cve_list=cves(_c("id")), target=_c("target"), description=_c("title"), remediation=_filled(_c("fixed")), evidence=F.concat_ws(" ", "library", "installed"))


def dependency_check(docs: DataFrame) -> DataFrame:
    flaw = "struct<name:string,severity:string,description:string,cwes:array<string>,cvssv3:struct<baseScore:double>,cvssv2:struct<score:double>>"
    rows = _json(docs, f"struct<dependencies:array<struct<fileName:string,vulnerabilities:array<{flaw}>>>>").select("file", F.explode("d.dependencies").alias("p")).select("file", _c("p.fileName").alias("part"), F.explode("p.vulnerabilities").alias("v"))
    v = F.col("v")
    return _finding(rows, "OWASP Dependency-Check", plugin_id=v["name"], title=F.concat_ws(" in ", v["name"], "part"), severity=S.normalised(v["severity"]), severity_score=F.coalesce(v["cvssv3"]["baseScore"], v["cvssv2"]["score"]), cve_list=F.concat(cves(v["name"]), cwes(F.concat_ws(" ", v["cwes"]))), target=_c("part"), description=v["description"], evidence=F.concat_ws(" ", "part", v["name"]))


def npm_audit(docs: DataFrame) -> DataFrame:
    """Version 2 names advisories by package (pointers to other packages are skipped), version 1 lists them."""
    via = "struct<name:string,title:string,url:string,severity:string,range:string,cwe:array<string>,cvss:struct<score:double>>"
    second = _json(docs, "struct<vulnerabilities:map<string,struct<severity:string,range:string,via:array<string>>>>").select("file", F.explode("d.vulnerabilities").alias("package", "e"))
    second = second.select("file", "package", _c("e.severity").alias("s"), F.explode("e.via").alias("raw")).select("file", "package", "s", F.from_json("raw", via).alias("v")).filter("v.title IS NOT NULL")
    second = second.select("file", F.coalesce("v.name", "package").alias("package"), "v.title", F.coalesce("v.severity", "s").alias("severity"), "v.range", "v.url", F.concat_ws(" ", "v.cwe").alias("cwe"), F.col("v.cvss.score").alias("score"))
    one = "struct<title:string,severity:string,module_name:string,vulnerable_versions:string,cwe:string,url:string>"
    first = _json(docs, f"struct<advisories:map<string,{one}>>").select("file", F.explode("d.advisories").alias("k", "a"))
    first = first.select("file", _c("a.module_name").alias("package"), "a.title", "a.severity", _c("a.vulnerable_versions").alias("range"), "a.url", "a.cwe", F.lit(None).cast("double").alias("score"))
    rows = second.unionByName(first)
    return _finding(rows, "npm audit", plugin_id=F.coalesce("url", "title"), title=F.format_string("%s (%s)", "title", "package"), severity=_level(_c("severity")), severity_score=_filled(_c("score").cast("string")).cast("double"), cve_list=F.concat(cves(F.concat_ws(" ", "url", "title")), cwes(_c("cwe"))), target=F.concat_ws(" ", F.lit("npm package"), "package", "range"), description=_c("title"), remediation=F.concat_ws(" ", F.lit("Affected:"), "range"), evidence=F.concat_ws(" ", "package", "range"))


def semgrep(docs: DataFrame) -> DataFrame:
    rows = _json(docs, "struct<results:array<struct<check_id:string,path:string,start:struct<line:bigint>,extra:struct<message:string,severity:string,metadata:struct<cwe:array<string>>>>>>").select("file", F.explode("d.results").alias("r"))
    r = F.col("r")
    return _finding(rows, "Semgrep", plugin_id=r["check_id"], title=F.coalesce(_filled(F.left(F.split(r["extra"]["message"], r"\. ")[0], F.lit(120))), r["check_id"]), severity=_level(r["extra"]["severity"]), cve_list=cwes(F.concat_ws(" ", r["extra"]["metadata"]["cwe"])), target=F.concat_ws(":", r["path"], r["start"]["line"].cast("string")), description=r["extra"]["message"], evidence=r["check_id"])


def pentest_csv(docs: DataFrame) -> DataFrame:
    """Tables of reports: a column of names, one of severities, and those of places, details and fixes."""
    rows = records(
        docs, lambda x: x.rlike(r'(?m)(^|[",])\s*"?(?:vulnerability|finding|observation)[^,"]*"?\s*[",]') & x.rlike("severity|risk rating"),
        title=("vulnerability", "vulnerability name", "finding", "finding title", "observation", "vulnerability title"), sev=("severity", "risk rating", "severity level"), score=("cvss", "cvss score"), cve=("cve", "cve id", "reference"), cwe=("cwe",),
        place=("host", "affected host", "affected asset", "affected url", "ip", "ip address", "url", "location"), text=("description", "details", "impact"), fix=("recommendation", "remediation", "solution"), proof=("poc", "proof of concept", "evidence"),
    )
    title, sev = F.col("title"), F.col("sev")
    return _finding(
        rows.filter(title.isNotNull() & sev.isNotNull()), "Pentest Report", title=title, severity=S.normalised(sev), severity_score=_number(F.col("score")), cve_list=F.concat(cves(F.concat_ws(" ", "cve")), cwes(F.col("cwe"))),
        target=F.coalesce("place", F.lit("Not recorded")), description=F.coalesce("text", title), remediation=F.col("fix"), evidence=F.coalesce("proof", title),
    )


# Console output of several tools in one file

BANNERS = {
    "nmap": r"Starting Nmap |Nmap scan report for ", "nikto": r"- Nikto v", "gobuster": r"Gobuster v", "dirb": r"DIRB v", "hydra": r"# Hydra v|Hydra v", "medusa": r"Medusa v", "masscan": r"Starting masscan ",
    "enum4linux": r"Starting enum4linux", "sslscan": r"Testing SSL server ", "sqlmap": r"sqlmap identified",
}


def segments(docs: DataFrame) -> DataFrame:
    """(file, nth, tool, content): a file cut where the banner of a tool begins a line; what stands before the first has none."""
    banner = "|".join(BANNERS.values())
    parts = F.filter(F.split("content", rf"(?m)(?=^(?:{banner}))"), lambda p: F.trim(p) != "")
    rows = docs.select("file", F.posexplode(parts).alias("nth", "content"))
    tool = S.cases([(F.col("content").rlike(f"^(?:{p})"), name) for name, p in BANNERS.items()])
    return rows.select("file", "nth", tool.alias("tool"), "content")
