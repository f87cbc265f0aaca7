"""Grok: named patterns expand to one regular expression, whose captures become typed columns."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values, as published: patterns by name; %{NAME} refers to another one.
PATTERNS = {
    # numbers and words
    "USERNAME": r"[a-zA-Z0-9._-]+",
    "USER": r"%{USERNAME}",
    "INT": r"(?:[+-]?(?:[0-9]+))",
    "BASE10NUM": r"[+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)",
    "NUMBER": r"%{BASE10NUM}",
    "BASE16NUM": r"(?:0[xX]?[0-9a-fA-F]+)",
    "BASE16FLOAT": r"[+-]?(?:0x)?(?:[0-9A-Fa-f]+(?:\.[0-9A-Fa-f]*)?|\.[0-9A-Fa-f]+)",
    "POSINT": r"\b(?:[1-9][0-9]*)\b",
    "NONNEGINT": r"\b(?:[0-9]+)\b",
    "WORD": r"\b\w+\b",
    "NOTSPACE": r"\S+",
    "SPACE": r"\s*",
    "DATA": r".*?",
    "GREEDYDATA": r".*",
    "QUOTEDSTRING": r"(?:\"(?:\\.|[^\\\"])*\"|'(?:\\.|[^\\'])*'|`(?:\\.|[^\\`])*`)",
    "QS": r"%{QUOTEDSTRING}",
    "UUID": r"[A-Fa-f0-9]{8}-(?:[A-Fa-f0-9]{4}-){3}[A-Fa-f0-9]{12}",
    "BOOL": r"(?:true|false|TRUE|FALSE|True|False)",
    # net
    "CISCOMAC": r"(?:(?:[A-Fa-f0-9]{4}\.){2}[A-Fa-f0-9]{4})",
    "WINDOWSMAC": r"(?:(?:[A-Fa-f0-9]{2}-){5}[A-Fa-f0-9]{2})",
    "COMMONMAC": r"(?:[A-Fa-f0-9]{2}:){5}[A-Fa-f0-9]{2}",
    "MAC": r"(?:%{CISCOMAC}|%{WINDOWSMAC}|%{COMMONMAC})",
    "IPV4": r"(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])",
    "IPV6": r"(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{0,4}::(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{0,4})",
    "IP": r"(?:%{IPV6}|%{IPV4})",
    "HOSTNAME": r"\b[0-9A-Za-z][0-9A-Za-z-]{0,62}(?:\.[0-9A-Za-z][0-9A-Za-z-]{0,62})*\.?",
    "HOST": r"%{HOSTNAME}",
    "IPORHOST": r"(?:%{IP}|%{HOSTNAME})",
    "HOSTPORT": r"%{IPORHOST}:%{POSINT}",
    "EMAILLOCALPART": r"[a-zA-Z0-9!#$%&'*+/=?^_\x60{|}~-]+(?:\.[a-zA-Z0-9!#$%&'*+/=?^_\x60{|}~-]+)*",
    "EMAILADDRESS": r"%{EMAILLOCALPART}@%{HOSTNAME}",
    # paths
    "UNIXPATH": r"(?:/[\w_%!$@:.,+~-]*)+",
    "TTY": r"/dev/(?:pts|tty(?:[pq])?)(?:\w+)?/?(?:[0-9]+)?",
    "WINPATH": r"(?:[A-Za-z]:|\\)(?:\\[^\\?*]*)+",
    "PATH": r"(?:%{UNIXPATH}|%{WINPATH})",
    "URIPROTO": r"[A-Za-z][A-Za-z0-9+.-]*",
    "URIHOST": r"%{IPORHOST}(?::%{POSINT})?",
    "URIPATH": r"(?:/[A-Za-z0-9$.+!*'(){},~:;=@#%&_\-]*)+",
    "URIPARAM": r"\?[A-Za-z0-9$.+!*'|(){},~@#%&/=:;_?\-\[\]<>]*",
    "URIPATHPARAM": r"%{URIPATH}(?:%{URIPARAM})?",
    "URI": r"%{URIPROTO}://(?:%{USER}(?::[^@]*)?@)?(?:%{URIHOST})?(?:%{URIPATHPARAM})?",
    "URN": r"urn:[0-9A-Za-z][0-9A-Za-z-]{0,31}:(?:%[0-9a-fA-F]{2}|[0-9A-Za-z()+,.:=@;$_!*'/?#-])+",
    "HTTPVERSION": r"HTTP/%{NUMBER}",
    # dates
    "MONTH": r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)",
    "MONTHNUM": r"(?:0?[1-9]|1[0-2])",
    "MONTHNUM2": r"(?:0[1-9]|1[0-2])",
    "MONTHDAY": r"(?:(?:0[1-9])|(?:[12][0-9])|(?:3[01])|[1-9])",
    "DAY": r"(?:Mon(?:day)?|Tue(?:sday)?|Wed(?:nesday)?|Thu(?:rsday)?|Fri(?:day)?|Sat(?:urday)?|Sun(?:day)?)",
    "YEAR": r"[0-9]{2}(?:[0-9]{2})?",
    "HOUR": r"(?:2[0123]|[01]?[0-9])",
    "MINUTE": r"(?:[0-5][0-9])",
    "SECOND": r"(?:(?:[0-5]?[0-9]|60)(?:[:.,][0-9]+)?)",
    "TIME": r"%{HOUR}:%{MINUTE}(?::%{SECOND})?",
    "DATE_US": r"%{MONTHNUM}[/-]%{MONTHDAY}[/-]%{YEAR}",
    "DATE_EU": r"%{MONTHDAY}[./-]%{MONTHNUM}[./-]%{YEAR}",
    "DATE": r"(?:%{DATE_US}|%{DATE_EU})",
    "DATESTAMP": r"%{DATE}[- ]%{TIME}",
    "TZ": r"(?:[APMCE][SD]T|UTC|GMT)",
    "ISO8601_TIMEZONE": r"(?:Z|[+-]%{HOUR}(?::?%{MINUTE}))",
    "ISO8601_SECOND": r"(?:%{SECOND}|60)",
    "TIMESTAMP_ISO8601": r"%{YEAR}-%{MONTHNUM}-%{MONTHDAY}[T ]%{HOUR}:?%{MINUTE}(?::?%{SECOND})?%{ISO8601_TIMEZONE}?",
    "DATESTAMP_RFC822": r"%{DAY} %{MONTH} %{MONTHDAY} %{YEAR} %{TIME} %{TZ}",
    "DATESTAMP_RFC2822": r"%{DAY}, %{MONTHDAY} %{MONTH} %{YEAR} %{TIME} %{ISO8601_TIMEZONE}",
    "DATESTAMP_OTHER": r"%{DAY} %{MONTH} %{MONTHDAY} %{TIME} %{TZ} %{YEAR}",
    "DATESTAMP_EVENTLOG": r"%{YEAR}%{MONTHNUM2}%{MONTHDAY}%{HOUR}%{MINUTE}%{SECOND}",
    "HTTPDATE": r"%{MONTHDAY}/%{MONTH}/%{YEAR}:%{TIME} %{INT}",
    # syslog
    "SYSLOGTIMESTAMP": r"%{MONTH} +%{MONTHDAY} %{TIME}",
    "PROG": r"[\x21-\x5a\x5c\x5e-\x7e]+",
    "SYSLOGPROG": r"%{PROG:program}(?:\[%{POSINT:pid}\])?",
    "SYSLOGHOST": r"%{IPORHOST}",
    "SYSLOGFACILITY": r"<%{NONNEGINT:facility}.%{NONNEGINT:priority}>",
    "SYSLOGBASE": r"%{SYSLOGTIMESTAMP:timestamp} (?:%{SYSLOGFACILITY} )?%{SYSLOGHOST:logsource} %{SYSLOGPROG}:",
    "LOGLEVEL": r"(?:[Aa]lert|ALERT|[Tt]race|TRACE|[Dd]ebug|DEBUG|[Nn]otice|NOTICE|[Ii]nfo|INFO|[Ww]arn(?:ing)?|WARN(?:ING)?|[Ee]rr(?:or)?|ERR(?:OR)?|[Cc]rit(?:ical)?|CRIT(?:ICAL)?|[Ff]atal|FATAL|[Ss]evere|SEVERE|EMERG(?:ENCY)?|[Ee]merg(?:ency)?)",
    # apache
    "HTTPDUSER": r"(?:%{EMAILADDRESS}|%{USER})",
    "COMMONAPACHELOG": r"%{IPORHOST:clientip} %{HTTPDUSER:ident} %{HTTPDUSER:auth} \[%{HTTPDATE:timestamp}\] \"(?:%{WORD:verb} %{NOTSPACE:request}(?: HTTP/%{NUMBER:httpversion})?|%{DATA:rawrequest})\" %{INT:response} (?:%{INT:bytes}|-)",
    "COMBINEDAPACHELOG": r"%{COMMONAPACHELOG} %{QS:referrer} %{QS:agent}",
    # java
    "JAVACLASS": r"(?:[a-zA-Z$_][a-zA-Z$_0-9]*\.)*[a-zA-Z$_][a-zA-Z$_0-9]*",
    "JAVAFILE": r"(?:[a-zA-Z$_0-9. -]+)",
    "JAVAMETHOD": r"(?:<(?:cl)?init>|[a-zA-Z$_][a-zA-Z$_0-9]*)",
    "JAVATHREAD": r"(?:[A-Z]{2}-Processor[\d]+)",
    "CATALINA_DATESTAMP": r"%{YEAR}-%{MONTHNUM}-%{MONTHDAY} %{HOUR}:%{MINUTE}:%{SECOND}",
    "JAVASTACKTRACEPART": r"%{SPACE}at %{JAVACLASS:class}\.%{JAVAMETHOD:method}\(%{JAVAFILE:file}(?::%{INT:line})?\)",
}
_REFERENCE = re.compile(r"%\{(\w+)(?::([\w.@\[\]-]+))?(?::(\w+))?\}")
#: Fixed type names of captures.
TYPES = {"int": "int", "integer": "int", "long": "bigint", "float": "double", "double": "double", "bool": "boolean", "boolean": "boolean", "string": "string"}


def named_groups(pattern: str) -> tuple[str, list[tuple[str, int]]]:
    """A pattern with plain groups, and each named group's name and number.

    Java's group names are narrower than the language's, so names become numbers.
    """
    out, names, number, i, in_class = [], [], 0, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if c == "[" and not in_class:
            in_class = True
        elif c == "]" and in_class:
            in_class = False
        elif c == "(" and not in_class:
            m = re.compile(r"\(\?P?<([A-Za-z_][\w.@-]*)>").match(pattern, i)
            if m:
                number += 1
                names.append((m.group(1), number))
                out.append("(")
                i = m.end()
                continue
            if pattern[i + 1 : i + 2] != "?":
                number += 1
        out.append(c)
        i += 1
    return "".join(out), names


def expand(pattern: str, extra: dict[str, str] | None = None, depth: int = 0) -> tuple[str, dict[str, str]]:
    """A regular expression with named groups, and the types that captures ask for."""
    if depth > 20:
        raise ValueError("patterns refer to each other in a circle")
    library = PATTERNS | (extra or {})
    types: dict[str, str] = {}

    def put(m: re.Match) -> str:
        name, field, kind = m.groups()
        if name not in library:
            raise ValueError(f"unknown pattern {name!r}")
        inner, found = expand(library[name], extra, depth + 1)
        types.update(found)
        if not field:
            return f"(?:{inner})"
        field = field.strip("[]").replace("][", ".")
        if kind:
            if kind.lower() not in TYPES:
                raise ValueError(f"unknown type {kind!r}")
            types[field] = TYPES[kind.lower()]
        return f"(?<{field}>{inner})"

    return _REFERENCE.sub(put, pattern), types


def extract(df: DataFrame, field: str, pattern: str, types: dict[str, str] | None = None) -> DataFrame:
    """Named groups of the first match as columns; rows without a match keep what they had."""
    plain, names = named_groups(pattern)
    if not names:
        raise ValueError("the pattern has no named group")
    text = F.col(field).cast("string")
    hit = F.coalesce(text.rlike(plain), F.lit(False))
    new = {}
    for name in dict.fromkeys(n for n, _ in names):
        groups = [F.regexp_extract(text, plain, i) for n, i in names if n == name]
        value = groups[0] if len(groups) == 1 else F.coalesce(*(F.nullif(g, F.lit("")) for g in groups), F.lit(""))
        kind = (types or {}).get(name)
        if kind:
            value = F.nullif(value, F.lit("")).try_cast(kind)
        same = name in df.columns and (kind is None or dict(df.dtypes)[name] == kind) and dict(df.dtypes)[name] in ("string", kind)
        new[name] = F.when(hit, value).otherwise(F.col(f"`{name}`") if same else F.lit(None))
    return df.withColumns(new)


def grok(df: DataFrame, field: str, pattern: str, keep: bool = True, extra: dict[str, str] | None = None) -> DataFrame:
    expanded, types = expand(pattern, extra)
    out = extract(df, field, expanded, types)
    return out if keep else out.drop(field)
