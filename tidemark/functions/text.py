"""Text functions as column expressions: words, shingles, artifacts, cues, redaction, categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The patterns and word lists that decide the results of the text functions.
WORD = r"([a-z][a-z']+)"
URL = r"https?://[^\s\"'<>)\]]+"
EMAIL = r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"
PERSONAL_MAIL = r"(?i)@(gmail|googlemail|yahoo|hotmail|outlook|live|icloud|me|aol|gmx|proton(mail)?|pm)\."
PHONE = r"(?<![\w.])(?:\+?\d{1,3}[ .-]?)?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?![\w.])"
CLAIM = r"(?i)\b(pushed|merged|deployed|fixed|verified|confirmed|published|is live|now live|went live|done|completed|committed|passed|tested|created|updated|added|resolved|submitted|opened|closed|approved|uploaded|installed|launched|shipped|working now|works now)\b|✅"
FIRST_PERSON = r"\b(I|I've|I'd|I'm|I just|we|we've|my)\b"
DOUBT = r"(?i)\b(not sure|unsure|unclear|may not have|might not have|didn'?t work|did not work|doesn'?t work|failed|can'?t verify|cannot verify|could not verify|unable to|couldn'?t|not verified|unverified|i assume|assuming|hopefully|i think it)\b"
CORRECTION = r"(?i)\b(actually|correction|retract\w*|was wrong|wasn'?t|didn'?t|did not|not actually|turns out|my mistake|apolog\w*|mistaken|incorrect)\b"
ABSENT = r"(?i)could not resolve to an? |\bHTTP 404\b|\b404 Not Found\b|\"status\":\s*\"404\"|\"message\":\s*\"Not Found\"|(?<!command )\bnot found\b|does(?:n'?t| not) exist|unknown revision|no pull requests? found"
INTENT = r"(?i)without (?:being |getting )?(?:detected|noticed|caught|flagged)|(?:not|never|don'?t|won'?t) (?:reveal|disclose|tell (?:anyone|them|the others))|keep (?:it|this|my (?:role|plan)) (?:secret|private|hidden|quiet)|act (?:like|as if|normal)|pretend|appear (?:normal|innocent)|cover (?:story|my tracks)|avoid (?:detection|suspicion|being (?:caught|detected|noticed))|evad\w* (?:the )?(?:scan|filter|check|detect\w*|monitor\w*|review\w*)|(?:bypass|get past|slip (?:past|through)|sneak (?:past|through)) (?:the )?(?:scan|filter|check|detect\w*|monitor\w*|review\w*)|undetected|blend in|deflect|mislead|(?:lie|lying) (?:about|to)|throw (?:them|people|others) off|plausible deniability|subtle (?:reference|hint|way)|(?:raise|arouse) suspicion"
CUES = {"claim": CLAIM, "first_person": FIRST_PERSON, "doubt": DOUBT, "correction": CORRECTION, "absent": ABSENT, "intent": INTENT}
ISSUE = r"(?i)(?:#|\b(?:prs?|pull requests?|pulls?|issues?)\s*(?:view|review|merge|close|comment|checks|edit|reopen|diff|list)?\s*#?)(\d{1,6})\b"
COMMIT = r"\b((?=[0-9a-f]*[a-f])(?=[0-9a-f]*\d)[0-9a-f]{7,40})\b"
FILE = r"(?i)\b([\w\-]+\.(?:md|py|js|ts|tsx|jsx|json|html|css|ya?ml|txt|csv|sh|ics))\b"
PLACE = r"https?://([\w.\-]+(?:/[\w.\-~%]+){0,2})"
REPOSITORY = r"(?:github\.com/[\w.\-]+/|--repo\s+[\w.\-]+/|/tmp/|/repos/|computeruse/)([\w\-]{3,})"
SECRET = r"(?i)\b(?:sk|pk|ghp|gho|xox[bp]|hf)[-_][A-Za-z0-9_-]{12,}|\b(?:api[_-]?key|access[_-]?token|auth[_-]?token|token|password|passwd|secret)\s*[:=]\s*[\"']?(?=[A-Za-z0-9_./+-]*\d)[A-Za-z0-9_./+-]{8,}"
MARKUP = r"(?is)<\s*(script|iframe|style|svg|object)\b.*?(?:<\s*/\s*\1\s*>|$)|</?\s*(?:script|iframe|object|embed|svg|img|style|form|meta|link)\b.*?(?:>|$)|javascript\s*:|\bon[a-z]{3,12}\s*=|\{\{.*?\}\}|<!--.*?-->|\{\|.*?\|\}"
COMMAND = r"(?im)^\s*(?:\$\s*)?(?:curl|wget|nc|ncat|python3?|bash|sh|powershell|nmap|sqlmap)\s.*$|\b(?:curl|wget|nmap|sqlmap)\s+(?:-|['\"]|https?:).*$|\$\([^)]*\)|`[^`\n]*(?:\|\s*\w|&&|;\s*\w|\$\(|\b(?:curl|wget|sudo|chmod|rm -)\b)[^`\n]*`"
ANY_EMAIL = r"(?<![\w.%+-])[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b"
ADDRESS = r"(?i)\b(?:\d{1,3}\.){3}\d{1,3}(?::\d+)?\b|\b(?:localhost|0x[0-9a-f]{6,})\b"
ENCODED = r"[^\s\[\]]*%[0-9A-Fa-f]{2}[^\s\[\]]*|\b[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9])"
LINK_SCHEMES = ["https", "http", "ftp", "file", "data"]
SKIP_PROGRAMS = ["cd", "echo", "sleep", "export", "set", "true", "source", ".", "printf", "pwd", "clear", "then", "fi", "do", "done", "else", "if", "for", "while"]
SUB_COMMANDS = ["git", "gh", "npm", "npx", "pip", "pip3", "docker", "kubectl", "cargo", "yarn", "pnpm", "apt", "apt-get", "brew", "systemctl"]
BEFORE_PROGRAM = r"^(?:(?:[A-Za-z_]\w*=\S*|sudo|timeout|time|nohup|env|exec|\(|\{|\d+[smh]?)(?:\s+|$))+"
DATA_FILE = r"(?i)\.(json|md|txt|html?|csv|ya?ml|log|xml|png|jpe?g)$"
INJECTION = r"(?i)(\b(or|and)\b\s*'?\d+'?\s*=\s*'?\d+|\bunion\b\s+(all\s+)?\bselect\b|'\s*--|;\s*--|\bsleep\s*\(|<\s*script|\.\./\.\./|%00)"
CACHE_TAG = r"(?i)[?&](zz|zzbulk|cb|nonce|prepnonce|uniq|rand|ts|_)=[^&]{3,}"
REDIRECT = r"(?i)redirect[^?]*\?[^ ]*url=|[?&](url|u|target|dest)=https?%3a"
KEPT_KEYS = ["id", "event_id", "ts", "first", "last", "from", "to", "since", "until", "anchor", "kind", "actor", "status", "verdict", "severity", "confidence", "type", "src", "dst"]
FAMILIES = [("claude", "Claude"), ("gpt", "GPT"), ("o1-", "GPT"), ("o3", "GPT"), ("o4", "GPT"), ("gemini", "Gemini"), ("deepseek", "DeepSeek"), ("glm", "GLM"), ("kimi", "Kimi"), ("grok", "Grok")]


def tokens(text: Column, limit: int | None = None) -> Column:
    """Lower-case words of two letters or more; with a limit, of the first limit characters only."""
    return F.regexp_extract_all(F.lower(text if limit is None else F.substring(text, 1, limit)), F.lit(WORD), F.lit(1))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingles(text: Column, width: int = 8) -> Column:
    """The distinct joined runs of width words; empty for shorter texts.

    The words are bound once, as the element of a one-element array: inside the inner lambda they would be split again for every run.
    """

    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.array_join(F.slice(w, i, width), " "))
        return F.when(F.size(w) >= width, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(words(text)), of)[0]


def cue(text: Column, name: str) -> Column:
    return text.rlike(CUES[name])


def artifacts(text: Column) -> Column:
    """n:<issue>, c:<first 7 of a commit>, f:<file>, u:<host and two path parts>, r:<repository> tokens of a text, distinct, in order of value."""
    found = (("n:", ISSUE), ("c:", COMMIT), ("f:", FILE), ("u:", PLACE), ("r:", REPOSITORY))

    def tagged(mark: str, pattern: str) -> Column:
        def token(x: Column) -> Column:
            x = F.lower(x)
            return F.concat(F.lit(mark), F.substring(x, 1, 7) if mark == "c:" else F.regexp_replace(x, r"[/.]+$", "") if mark == "u:" else x)

        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), token)

    return F.array_sort(F.array_distinct(F.concat(*[tagged(mark, pattern) for mark, pattern in found])))


def redact(text: Column) -> Column:
    """Secrets, markup, commands, links, e-mails, addresses and encoded strings by notes, in this order; a link keeps its host."""
    out = text
    for pattern, what in ((SECRET, "secret"), (MARKUP, "markup"), (COMMAND, "command")):
        out = F.regexp_replace(out, pattern, f"[{what} withheld]")
    end = r"[^\s<>\"')\]]"
    for scheme in LINK_SCHEMES:
        long = max(0, 61 - len(scheme) - 3)
        detail = rf"(?i){scheme}://(?={end}*[?#%=&]|{end}{{{long},}})([^/?#:\s<>\"')\]]+){end}*"
        out = F.regexp_replace(out, detail, "[link to $1 — details withheld]")
        out = F.regexp_replace(out, rf"(?i){scheme}://([^/?#:\s<>\"')\]]+){end}*", "[link to $1]")
        out = F.regexp_replace(out, rf"(?i){scheme}://{end}*", "[link withheld]")
    for pattern, what in ((ANY_EMAIL, "email"), (ADDRESS, "address"), (ENCODED, "encoded text")):
        out = F.regexp_replace(out, pattern, f"[{what} withheld]")
    return out


def redact_value(value: Column, kind: T.DataType, key: str | None = None) -> Column:
    """value with every string in it redacted, through structs, arrays and the values of maps; identifiers and times, by name, are left alone."""
    if isinstance(kind, T.StringType):
        return value if key in KEPT_KEYS else redact(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: redact_value(x, kind.elementType, key))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda k, x: redact_value(x, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[redact_value(value[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields]))
    return value


def delexicalise(text: Column) -> Column:
    """E-mails, links, dates, times, long hexadecimal ids and numbers by their class."""
    out = text
    for pattern, name in ((EMAIL, "EMAIL"), (URL, "LINK"), (r"\b\d{4}-\d{2}-\d{2}\b", "DATE"), (r"\b\d{1,2}:\d{2}(?::\d{2})?\b", "TIME"), (r"\b[0-9a-fA-F]{8,}\b", "ID"), (r"\d+(?:[.,]\d+)*", "NUM")):
        out = F.regexp_replace(out, pattern, name)
    return out


def url_category(url: Column) -> Column:
    """What a requested address shows, as an array."""
    decode = lambda c: F.coalesce(F.try_url_decode(c), c)
    path = F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    name = host(url)
    flags = F.array(
        F.when(name != "", F.concat(F.lit("requested: "), name)), F.when(decode(query).rlike(INJECTION) | decode(path).rlike(INJECTION), "request: query shaped like code injection"),
        F.when(F.concat(F.lit("?"), query).rlike(CACHE_TAG), "request: random tag that defeats caching"), F.when(url.rlike(REDIRECT), "request: routed through a redirect service"),
        F.when(F.substring(path, 2, 10**6).contains("//"), "request: unusual path (doubled slashes)"),
    )
    return F.filter(flags, lambda x: x.isNotNull())


def host(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^[a-z]+://([^/:?#]+)", 1)


def value_form(value: Column) -> Column:
    """number (up to nine digits, perhaps a minus), word, token, or other."""
    return (
        F.when(value.rlike(r"^-?\d{1,9}\z"), F.lit("number")).when(value.rlike(r"^[A-Za-z]+\z"), F.lit("word"))
        .when(value.rlike(r"^[\w.\-|:/]+\z"), F.lit("token")).otherwise(F.lit("other"))
    )


def number_tokens(text: Column) -> Column:
    """The distinct numbers of a text, thousands separators dropped, in order of value as text."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(\d[\d,]*(?:\.\d+)?)"), F.lit(1)), lambda x: F.replace(F.regexp_replace(x, r",+$", ""), F.lit(","), F.lit("")))))


def shell_program(command: Column) -> Column:
    """The first program of a command that does something, with its sub-command where it has some: git push, gh pr create, python3; null if there is none."""
    bare = F.when(F.substring(command, 1, 20).rlike(r"^\s*\w+:"), F.regexp_replace(command, r"^[^:]*:", "")).otherwise(command)
    parts = F.split(F.substring(bare, 1, 600), r"&&|\|\||;|\||\n")

    def program(part: Column) -> Column:
        rest = F.split(F.regexp_replace(F.trim(part), BEFORE_PROGRAM, ""), r"\s+")
        name = F.regexp_replace(F.regexp_replace(rest[0], r"^['\"()]+|['\"()]+$", ""), r"^.*/", "")
        words = F.filter(F.slice(rest, 2, 3), lambda w: w.rlike(r"^[a-z][\w-]*$"))
        second = F.try_element_at(words, F.lit(1))
        third = F.when(name == "gh", F.try_element_at(words, F.lit(2)))
        whole = F.when(name.isin(SUB_COMMANDS), F.concat_ws(" ", name, second, third)).otherwise(name)
        return F.when(name.rlike(r"^[\w.+-]+$") & ~name.isin(SKIP_PROGRAMS) & ~name.rlike(DATA_FILE), whole)

    return F.try_element_at(F.filter(F.transform(parts, program), lambda p: p.isNotNull()), F.lit(1))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def model_family(name: Column) -> Column:
    low, out = F.lower(name), None
    for key, family in FAMILIES:
        out = F.when(low.contains(key), F.lit(family)) if out is None else out.when(low.contains(key), F.lit(family))
    return out.otherwise(F.lit("Other"))


def iso_week(ts: Column) -> Column:
    return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), ts), F.weekofyear(ts))
