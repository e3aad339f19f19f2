"""Rule packs. A pack is a list of rules; any list of the same form can be scanned.

The patterns, severities and flags are fixed values that results depend on.
"""

from __future__ import annotations

from dataclasses import dataclass

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
#: What a finding takes off the score (fixed values).
WEIGHTS = {"CRITICAL": 25, "HIGH": 15, "MEDIUM": 8, "LOW": 3, "INFO": 1}


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str
    category: str
    pattern: str
    critical: bool = False
    skip: tuple[str, ...] = ()


#: Fixed values.
SECURITY = (
    Rule("SEC001", "CRITICAL", "Secrets", r"""(?i)(?:password|passwd|pwd)\s*=\s*['"][^'"]{3,}['"]"""),
    Rule("SEC002", "CRITICAL", "Secrets", r"""(?i)(?:api[_-]?key|apikey|access[_-]?token)\s*=\s*['"][A-Za-z0-9_\-\.]{10,}['"]"""),
    Rule("SEC003", "CRITICAL", "Secrets", r"AKIA[0-9A-Z]{16}"),
    Rule("SEC004", "HIGH", "Code Execution", r"\beval\s*\("),
    Rule("SEC005", "HIGH", "Code Execution", r"\bexec\s*\("),
    Rule("SEC006", "CRITICAL", "Injection", r"""(?i)(?:execute|query)\s*\(\s*f?["'].*(?:\+|%s|\{.*\}).*["']"""),
    Rule("SEC007", "HIGH", "Cryptography", r"hashlib\.(?:md5|sha1)\s*\("),
    Rule("SEC008", "MEDIUM", "Network", r"verify\s*=\s*False"),
    Rule("SEC009", "MEDIUM", "Network", r"http://(?!localhost|127\.|0\.0\.0\.0)"),
    Rule("SEC010", "MEDIUM", "Configuration", r"(?i)debug\s*=\s*True"),
    Rule("SEC011", "HIGH", "Injection", r"""(?i)(?:os\.system|subprocess).*(?:f?['"]|.*\+)"""),
    Rule("SEC012", "HIGH", "Deserialization", r"pickle\.(?:loads?|Unpickler)"),
    Rule("SEC013", "LOW", "Information Disclosure", r"(?i)print\s*\(.*(?:password|token|key|secret)"),
    Rule("SEC014", "CRITICAL", "Secrets", r"-----BEGIN\s(?:RSA\s)?PRIVATE KEY-----"),
    Rule("SEC015", "HIGH", "Secrets", r"""(?i)(?:mongodb|postgresql|mysql|redis)://[^"'\s]{5,}"""),
)

#: Fixed values.
POLICY = (
    Rule("POL001", "HIGH", "system files", r"(?i)(shutil\.rmtree|os\.remove).*(/etc|/sys|/bin)", True),
    Rule("POL002", "HIGH", "key capture", r"(?i)(keylog|keystroke|capture.*password)", True),
    Rule("POL003", "HIGH", "ransom", r"(?i)(encrypt|AES|Fernet).*(walk|glob).*\.(doc|pdf)", True),
    Rule("POL004", "HIGH", "intrusion", r"(?i)(brute.?force|reverse.?shell|bind.?shell)", True),
    Rule("POL005", "HIGH", "obfuscation", r"(?i)(exec|eval)\s*\(\s*(base64|b64|decode)", True),
    Rule("POL006", "HIGH", "privileges", r"(?i)(setuid|chmod.*777|sudo.*silent)", True),
    Rule("POL007", "MEDIUM", "download and run", r"(?i)(download|fetch).*(exe|sh|bat).*run"),
    Rule("POL008", "MEDIUM", "hidden upload", r"(?i)(requests\.(post|put)).*(password|key|secret)"),
    Rule("POL009", "MEDIUM", "system files", r"(?i)open.*(/etc/hosts|/etc/crontab|/etc/sudoers)"),
    Rule("POL010", "MEDIUM", "disk commands", r"(dd if=|mkfs\.|fork bomb|> /dev/sd)"),
)

#: Corpus exclusion filters. Fixed values; '.' matches newlines here.
CONTENT = (
    Rule("CON001", "CRITICAL", "weapons", r"(?is)\b(synthesize|manufacture|detonate|build).{0,30}(bomb|explosive|C4|TNT|TATP|weapon)", True),
    Rule("CON002", "CRITICAL", "narcotics", r"(?is)\b(synthesize|manufacture|cook).{0,30}(meth|fentanyl|heroin|cocaine|drug)", True),
    Rule("CON003", "CRITICAL", "phishing", r"(?is)(fake.?login|credential.?harvest|phishing.?page|steal.?password)", True),
    Rule("CON004", "CRITICAL", "keylogger", r"(?is)(keylog|keystroke.capture|hook.keyboard).{0,50}(send|upload|exfil)", True, ("java_android", "java")),
    Rule("CON005", "CRITICAL", "malware", r"(?is)(create|build|write).{0,20}(ransomware|rootkit|botnet|trojan.payload)", True),
    Rule("CON006", "CRITICAL", "infrastructure", r"(?is)(attack|exploit|compromise).{0,30}(power.grid|water.supply|hospital.system)", True),
    Rule("CON007", "CRITICAL", "child safety", r"(?is)(child.{0,10}(porn|abuse|exploit)|CSAM|minor.{0,10}sexual)", True),
)

#: Checks of the guard by language. A trailing \b after '(' or '=' asks for a
#: word character right there. Fixed values.
GUARD = {
    ("JAVA", "KOTLIN"): (
        Rule("AI101", "", "reflection", r"(?i)\b(Class\.forName|Method\.invoke|Field\.set|Constructor\.newInstance|setAccessible|defineClass)\b"),
        Rule("AI102", "", "native code", r"(?i)\b(System\.loadLibrary|Runtime\.load|JNI|native\s+)\b"),
        Rule("AI103", "", "deserialization", r"(?i)\b(ObjectInputStream|readObject|readUnshared)\b", True),
        Rule("AI104", "", "process execution", r"(?i)\b(ProcessBuilder|Runtime\.getRuntime\.exec|Runtime\.exec)\b", True),
    ),
    ("PYTHON",): (
        Rule("AI201", "", "dynamic import", r"(?i)\b(__import__|importlib|imp\.import_module)\b"),
        Rule("AI202", "", "unsafe load", r"(?i)\b(pickle\.loads|yaml\.load\s*\(|marshal\.loads|marshal\.load)\b", True),
        Rule("AI203", "", "C interface", r"(?i)\b(ctypes|cffi|ctypes\.CDLL)\b"),
    ),
    ("JAVASCRIPT",): (
        Rule("AI301", "", "function constructor", r"(?i)\bnew\s+Function\s*\(", True),
        Rule("AI302", "", "eval", r"(?i)\beval\s*\(", True),
        Rule("AI303", "", "child process", r"""(?i)\b(child_process|require\s*\(\s*['"]child_process['"]\s*\)|exec\s*\(|execSync|spawn\s*\()\b""", True),
        Rule("AI304", "", "DOM injection", r"(?i)\b(document\.write\s*\(|innerHTML\s*=|outerHTML\s*=|dangerouslySetInnerHTML)\b"),
        Rule("AI305", "", "prototype tampering", r"(?i)(__proto__|prototype\s*\[|Object\.setPrototypeOf)"),
        Rule("AI306", "", "hard-coded secret", r"""(?i)(api[_-]?key|secret|password|token)\s*[:=]\s*['"][A-Za-z0-9_\-]{12,}['"]""", True),
    ),
    ("HTML",): (
        Rule("AI401", "", "script tag", r"(?i)<script\b"),
        Rule("AI402", "", "inline event handler", r"(?i)\s(on\w+)\s*="),
        Rule("AI403", "", "javascript URL", r"(?i)javascript\s*:", True),
        Rule("AI404", "", "iframe", r"(?i)<iframe\b"),
    ),
}
