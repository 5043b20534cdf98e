"""The safety floor's patterns: commands that destroy data, and ways in which secrets leave.

All are Java regular expressions, applied with ``rlike`` as literals. Those in
``RE2_SAFE`` have no look-around and mean the same in RE2.
"""

from __future__ import annotations

from typing import NamedTuple


class Pattern(NamedTuple):
    name: str
    kind: str
    regex: str


# The fragments and the 27 patterns, which decide what is a finding.
WORD = r"[^\s;&|>]+"
SEG = r"[^\n;&|]*"
TMP = r"""["']?(?:/tmp\b|/private/tmp\b|/var/tmp\b|\$\{?TMPDIR\}?)"""
TMP_SAFE = rf"""{TMP}(?![^\s"']*/\.\.(?![\w.-]))"""
END = r"""(?=[\s'"\x60;&|)\]}]|\z)"""
OUTBOUND = r"(?:\b(?:curl|wget|fetch)\b|https?:)"
SECRET_NAME = r"(?:api[_-]?key|secret|token|passw(?:or)?d|authorization|credentials?)[\w-]*"
SECRET_ASSIGNMENT = rf"""{SECRET_NAME}['"]?\s*[=:]\s*['"]?(?:bearer\s+)?(?=[^\s'"\x60]{{12,}})"""
BARE_BEARER = r"\bbearer\s+(?=[A-Za-z0-9_\-.+/=]{20,})"
# Ends of lines, spelled out: Java's (?m) also breaks lines at U+0085.
LINE_START, LINE_END = r"(?<![^\n\r\u2028\u2029])", r"(?![^\n\r\u2028\u2029])"
# A secret whose line also has a way out, however far before or after it, or in its own name: a way out before counts for one without a line break.
SECRET = rf"(?:{SECRET_ASSIGNMENT}|{BARE_BEARER})"
SECRET_IN_LINE = SECRET.replace(r"\s", r"[^\S\n]").replace(r"[^[^\S\n]", r"[^\s")
OUTBOUND_AHEAD = rf"(?=[^\n]*{OUTBOUND})"
SECRET_WITH_OUTBOUND = rf"(?:{OUTBOUND}[^\n]*?(?:{SECRET_IN_LINE}|{SECRET}{OUTBOUND_AHEAD})|(?={SECRET_NAME}-(?:curl|wget|fetch)\b){SECRET_IN_LINE}|{SECRET}{OUTBOUND_AHEAD})"
ENV_FILE = r"\.env(?:rc)?\b(?!\.(?:example|sample|template|dist)\b)"

PATTERNS: tuple[Pattern, ...] = (
    Pattern("rm-recursive", "destructive", rf"(?i)(?<!\bgit\s)\brm\s+(?=(?:{WORD}\s+){{0,8}}-(?:-recursive|-force|[a-z]*[rf])\b)(?:-\S+\s+|{TMP_SAFE}\S*\s+)*(?!{TMP_SAFE}|-){WORD}"),
    Pattern("git-push-force", "destructive", rf"(?i)\bgit\s+push\b(?:\s+{WORD})*?\s+(?:--force\b\S*|-[a-z]*f[a-z]*\b|\+{WORD})"),
    Pattern("git-reset-hard", "destructive", rf"(?i)\bgit\s+reset\b{SEG}?--hard\b"),
    Pattern("git-clean-force", "destructive", rf"(?i)\bgit\s+clean\b(?:\s+{WORD})*?\s+(?:-[a-z]*f[a-z]*|--force)\b"),
    Pattern("git-branch-delete-force", "destructive", rf"\bgit\s+branch\b(?:(?={SEG}\s-[a-zA-Z]*D)|(?={SEG}\s-(?=[a-zA-Z]*d)(?=[a-zA-Z]*f)[a-zA-Z]+\b)|(?={SEG}\s(?:-d|--delete)\b)(?={SEG}\s(?:-f|--force)\b)){SEG}"),
    Pattern("git-checkout-discard", "destructive", rf"(?i)\bgit\s+(?:checkout|restore)\s+(?:--\s+)?\./?{END}"),
    Pattern("sql-drop", "destructive", r"(?i)\bDROP\s+(?:TABLE|DATABASE|SCHEMA)\b"),
    Pattern("sql-truncate", "destructive", rf"""(?i)\bTRUNCATE\s+TABLE\b|(?:{LINE_START}|(?<=[;:("'\x60]))\s*\bTRUNCATE\s+(?:ONLY\s+)?["\x60\[]?[\w.]+["\x60\]]?[ \t]*(?=;|['"\x60]|\bCASCADE\b|\bRESTART\b|\bCONTINUE\b)"""),
    Pattern("sql-delete-without-where", "destructive", r"""(?i)\bDELETE\s+FROM\s+(?:ONLY\s+)?["\x60\[]?[\w.]+["\x60\]]?[ \t]*(?=;|\n|\\n|\z|['"\x60]|\bRETURNING\b|\bLIMIT\b|\bORDER\b)"""),
    Pattern("mkfs", "destructive", rf"(?i)\bmkfs(?:\.\w+)?\s+(?=(?:{WORD}\s+){{0,8}}(?:/dev/|\$\{{?\w|-t\b)){SEG}"),
    Pattern("dd-to-device", "destructive", rf"(?i)\bdd\s+{SEG}\bof=/dev/(?!null\b|zero\b|stdout\b|stderr\b)"),
    Pattern("redirect-to-device", "destructive", r"(?i)>\s*/dev/(?:sd|hd|nvme|xvd|vd|mmcblk|disk)"),
    Pattern("chmod-recursive-777", "destructive", rf"(?i)\bchmod\s+(?=(?:{SEG}\s)?-(?:[a-z]*R|-recursive))(?={SEG}\b0?777\b){SEG}"),
    Pattern("chown-recursive", "destructive", rf"(?i)\bchown\s+(?=(?:{SEG}\s)?-(?:[a-z]*R|-recursive)){SEG}"),
    Pattern("fork-bomb", "destructive", r"(?i):\s*\(\s*\)\s*\{\s*:"),
    Pattern("pipe-to-shell", "destructive", r"(?i)\b(?:curl|wget)\b[^\n|;]*\|\s*(?:sudo\s+(?:-\S+\s+)*)?(?:ba|z|da|k|fi)?sh\b"),
    Pattern("kill-all", "destructive", r"(?i)\bkill\s+(?:-9|-KILL|-SIGKILL|-s\s+(?:SIG)?KILL)\s+-1\b"),
    Pattern("shutdown", "destructive", rf"""(?i)(?:{LINE_START}|[;&|\x60("'])\s*(?:sudo\s+)?(?:shutdown|reboot|halt|poweroff|init\s+[06]|systemctl\s+(?:reboot|poweroff|halt))\b(?=\s*{LINE_END}|\s*[;&|)\x60"']|\s+-|\s+now\b|\s+\+?\d)"""),
    Pattern("terraform-destroy", "destructive", r"(?i)\b(?:terraform|tofu|pulumi)\s+destroy\b"),
    Pattern("kubectl-delete-namespace", "destructive", rf"(?i)\bkubectl\s+delete\s+(?:(?:ns|namespaces?)\b|{SEG}--all\b)"),
    Pattern("aws-s3-rm-recursive", "destructive", rf"(?i)\baws\s+s3\s+(?:rm\b{SEG}--recursive\b|rb\b{SEG}--force\b)"),
    Pattern("secret-in-outbound", "exfiltration", rf"(?i){SECRET_WITH_OUTBOUND}"),
    Pattern("cat-env", "exfiltration", rf"(?i)\b(?:cat|bat|less|more)\s+{SEG}{ENV_FILE}"),
    Pattern("env-piped-out", "exfiltration", r"(?i)\b(?:printenv|env)\b[^\n;|]*(?:\|[^\n;|]*)*?\|\s*(?:curl|wget|nc|ncat|netcat|socat)\b"),
    Pattern("scp-rsync-remote", "exfiltration", rf"""(?i)\b(?:scp|rsync|sftp)\s+(?:{WORD}\s+)+\w[\w.-]*@[\w.-]+:[^\s;&|"'\x60]*[ \t]*(?={LINE_END}|[;&|)"'\x60])"""),
    Pattern("base64-env", "exfiltration", rf"(?i)\bbase64\b[^\n;|]*{ENV_FILE}"),
    Pattern("reverse-shell", "exfiltration", rf"(?i)\b(?:nc|ncat|netcat)\s+{SEG}-e\s|/dev/tcp/"),
)
EVIDENCE_CHARS = 120

#: Patterns without look-around.
RE2_SAFE = tuple(p for p in PATTERNS if "(?=" not in p.regex and "(?!" not in p.regex and "(?<" not in p.regex and "\\z" not in p.regex)
