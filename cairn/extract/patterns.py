"""Evidence of files in other languages, by patterns for declarations, imports and calls.

A language is a Spec; a symbol ends where its block does: at the closing brace, at the
end mark, or before the next line that is indented no more.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.paths import module_name

#: Words before a parenthesis that are no calls.
NO_CALLS = frozenset("if for while switch catch return function fn func match with elseif foreach sizeof typeof new super await async yield in of and or not class def sub end".split())
CALL = re.compile(r"(?<![\w.])((?:[A-Za-z_$][\w$]*\s*(?:\.|::)\s*)*)([A-Za-z_$][\w$]*)\s*\(")


@dataclass(frozen=True)
class Spec:
    language: str
    suffixes: tuple[str, ...]
    symbols: tuple[tuple[str, str], ...]
    imports: tuple[str, ...] = ()
    block: str = "brace"
    end: str = ""
    comment: str = r"//.*|/\*.*?\*/"
    flags: int = 0
    compiled: tuple = field(default=(), compare=False)


def _spec(language: str, suffixes: str, symbols: dict[str, str], imports: tuple[str, ...] = (), **more) -> Spec:
    return Spec(language, tuple(suffixes.split()), tuple(symbols.items()), imports, **more)


_WORD = r"([A-Za-z_$][\w$]*)"

def _decl(modifiers: str, keywords: str, name: str = _WORD) -> str:
    """A declaration by a language's grammar: any of its modifiers, each perhaps with an argument, a keyword, and a name."""
    return rf"^\s*(?:(?:{'|'.join(modifiers.split())})(?:\s*\([^)]*\))?\s+)*(?:{'|'.join(keywords.split())})\s+{name}"


_TS, _MOVE, _CAIRO, _CADENCE = "export default declare abstract async const", "public entry native inline friend", "pub extern", "access pub priv view"
SPECS = {s.language: s for s in (
    _spec("typescript", ".ts .tsx .js .jsx .mjs .cjs", {
        "class": _decl(_TS, "class"), "interface": _decl(_TS, "interface"), "enum": _decl(_TS, "enum"), "type": _decl(_TS, "type") + r"\b[^=(]*=", "function": _decl(_TS, r"function\b\s*\*?", _WORD),
        "arrow": _decl("export declare", "const let var") + r"\b[^=]*=[^;]*?(?:\)|[\w$])\s*(?::[^=;]+)?=>",
        "method": rf"^\s+(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b){_WORD}\s*\([^;]*\)\s*(?::[^{{]+)?\{{"},
        (r"""^\s*import\s+(?:[^'"]*?from\s+)?['"]([^'"]+)""", r"""require\(\s*['"]([^'"]+)""", r"""^\s*export\s+[^'"]*?from\s+['"]([^'"]+)""")),
    _spec("go", ".go", {"function": rf"^func\s+{_WORD}\s*[\[(]", "method": rf"^func\s*\([^)]*\)\s*{_WORD}\s*\(", "struct": rf"^type\s+{_WORD}\s+struct", "interface": rf"^type\s+{_WORD}\s+interface", "type": rf"^type\s+{_WORD}\s+(?!struct|interface)"},
          (r'^\s*import\s+(?:\w+\s+)?"([^"]+)"', r'^\s+(?:[\w.]+\s+)?"([^"]+)"\s*$')),
    _spec("rust", ".rs", {"function": rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+)*fn\s+{_WORD}", "struct": rf"^\s*(?:pub\s+)?struct\s+{_WORD}", "enum": rf"^\s*(?:pub\s+)?enum\s+{_WORD}",
                          "trait": rf"^\s*(?:pub\s+)?trait\s+{_WORD}", "impl": rf"^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?{_WORD}"}, (r"^\s*(?:pub\s+)?use\s+([\w:]+)", r"^\s*(?:pub\s+)?mod\s+(\w+)\s*;")),
    _spec("java", ".java", {"class": rf"^\s*(?:(?:public|private|protected|static|final|abstract|sealed)\s+)*(?:class|record)\s+{_WORD}", "interface": rf"^\s*(?:(?:public|private|protected|static)\s+)*interface\s+{_WORD}",
                            "enum": rf"^\s*(?:(?:public|private|protected|static)\s+)*enum\s+{_WORD}",
                            "method": rf"^\s+(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*(?:<[^>]+>\s+)?(?!return\b|new\b|else\b|throw\b)[\w<>\[\],.?]+\s+{_WORD}\s*\([^;]*\)\s*(?:throws [\w., ]+)?\{{"},
          (r"^\s*import\s+(?:static\s+)?([\w.]+)",)),
    _spec("powershell", ".ps1 .psm1", {"function": r"^\s*(?:function|filter)\s+([\w:-]+)", "class": rf"^\s*class\s+{_WORD}", "enum": rf"^\s*enum\s+{_WORD}"},
          (r"^\s*Import-Module\s+['\"]?([\w./\\-]+)", r"^\s*using\s+module\s+([\w./\\-]+)", r"^\s*\.\s+['\"]?([\w./\\$-]+\.ps1)"), comment=r"#.*", flags=re.I),
    _spec("vb", ".vb .vbs", {"class": rf"^\s*(?:(?:Public|Private|Friend|Partial)\s+)*(?:Class|Module|Structure)\s+{_WORD}", "function": rf"^\s*(?:(?:Public|Private|Protected|Friend|Shared|Overrides|Async)\s+)*(?:Function|Sub)\s+{_WORD}"},
          (r"^\s*Imports\s+([\w.]+)",), block="mark", end=r"^\s*End\s+(?:Class|Module|Structure|Function|Sub)\b", comment=r"'.*", flags=re.I),
    _spec("ada", ".adb .ads", {"package": r"^\s*package\s+(?:body\s+)?([\w.]+)", "function": rf"^\s*(?:function|procedure)\s+{_WORD}"}, (r"^\s*with\s+([\w.]+)",), block="mark", end=r"^\s*end\s+[\w.]+\s*;", comment=r"--.*", flags=re.I),
    _spec("cobol", ".cob .cbl .cpy", {"program": r"^.{0,7}\s*PROGRAM-ID\.\s+([\w-]+)", "section": r"^.{0,7}([\w-]+)\s+SECTION\s*\.", "paragraph": r"^.{7}([A-Z0-9][\w-]*)\.\s*$"}, (r"^\s*COPY\s+([\w-]+)",), block="next", comment=r"^.{6}\*.*", flags=re.I),
    _spec("mojo", ".mojo", {"struct": rf"^\s*(?:struct|trait|class)\s+{_WORD}", "function": rf"^\s*(?:fn|def)\s+{_WORD}"}, (r"^\s*(?:from|import)\s+([\w.]+)",), block="indent", comment=r"#.*"),
    _spec("cmake", ".cmake CMakeLists.txt", {"function": r"^\s*function\s*\(\s*(\w+)", "macro": r"^\s*macro\s*\(\s*(\w+)", "target": r"^\s*add_(?:library|executable)\s*\(\s*(\w+)"}, (r"^\s*(?:include|find_package|add_subdirectory)\s*\(\s*([\w./-]+)",),
          block="mark", end=r"^\s*end(?:function|macro)", comment=r"#.*", flags=re.I),
    _spec("vyper", ".vy", {"struct": rf"^\s*(?:struct|event|interface)\s+{_WORD}", "function": rf"^\s*def\s+{_WORD}"}, (r"^\s*(?:from|import)\s+([\w.]+)",), block="indent", comment=r"#.*"),
    _spec("move", ".move", {"module": _decl(_MOVE, "module", r"([\w:]+)"), "struct": _decl(_MOVE, "struct enum"), "function": _decl(_MOVE, "fun")}, (r"^\s*(?:use|friend)\s+([\w:]+)",)),
    _spec("cairo", ".cairo", {"struct": _decl(_CAIRO, "struct enum trait mod impl"), "function": _decl(_CAIRO, "fn")}, (r"^\s*(?:pub\s+)?use\s+([\w:]+)",)),
    _spec("clarity", ".clar", {"function": r"^\s*\(\s*define-(?:public|private|read-only)\b\s*\(\s*([^\s()]+)", "constant": r"^\s*\(\s*define-(?!public|private|read-only|trait)[a-z-]+\s+([^\s()]+)"}, (r"^\s*\(\s*(?:use|impl)-trait\b[^.']*'?([\w.-]+)",), block="next", comment=r";;.*"),
    _spec("cadence", ".cdc", {"contract": _decl(_CADENCE, "contract resource struct event enum", rf"(?:interface\s+)?{_WORD}"), "function": _decl(_CADENCE, "fun")}, (r'^\s*import\s+"?(\w+)',)))}


def language_of(path: str) -> str | None:
    """Language by the whole name, else by suffix."""
    name = path.rsplit("/", 1)[-1]
    for spec in SPECS.values():
        if name in spec.suffixes:
            return spec.language
    return "python" if name.endswith((".py", ".pyi")) else next((s.language for s in SPECS.values() if name.endswith(s.suffixes)), None)


def _ends(spec: Spec, lines: list[str], start: int, later: list[int]) -> int:
    """Index of the last line of a symbol that begins at ``start``."""
    if spec.block == "brace":
        depth = seen = 0
        for i in range(start, len(lines)):
            for c in lines[i]:
                depth += (c == "{") - (c == "}")
                seen |= c == "{"
            if seen and depth <= 0 or not seen and lines[i].rstrip().endswith(";"):
                return i
        return len(lines) - 1
    if spec.block == "mark":
        return next((i for i in range(start + 1, len(lines)) if re.match(spec.end, lines[i], spec.flags)), start)
    if spec.block == "indent":
        own = len(lines[start]) - len(lines[start].lstrip())
        last = start
        for i in range(start + 1, len(lines)):
            if lines[i].strip():
                if len(lines[i]) - len(lines[i].lstrip()) <= own:
                    break
                last = i
        return last
    return max(start, next((j for j in later if j > start), len(lines)) - 1)


def extract(path: str, text: str, language: str) -> dict:
    """The same evidence as of Python files; variables and flows are those of Python alone."""
    spec = SPECS[language]
    lines = [re.sub(spec.comment, "", line, flags=spec.flags) for line in text.split("\n")]
    found = []
    for i, line in enumerate(lines):
        for kind, pattern in spec.symbols:
            if m := re.match(pattern, line, spec.flags):
                found.append((i, kind, m[1]))
                break
    later = [i for i, _, _ in found]
    module, stack, symbols = module_name(path), [], []
    for i, kind, name in found:
        end = _ends(spec, lines, i, later)
        while stack and stack[-1][0] < i:
            stack.pop()
        qname = f"{stack[-1][1] if stack else module}.{name}"
        stack.append((end, qname))
        symbols.append({"qualified_name": qname, "name": name, "symbol_type": kind, "line_start": i + 1, "line_end": end + 1, "parameters": None})
    calls = []
    starts = {s["line_start"] - 1: s for s in symbols}
    for i, line in enumerate(lines):
        own = [s for s in symbols if s["line_start"] - 1 <= i <= s["line_end"] - 1 and s["symbol_type"] in ("function", "method", "arrow", "filter", "macro")]
        if not own:
            continue
        caller = max(own, key=lambda s: s["line_start"])
        for m in CALL.finditer(line):
            if m[2] in NO_CALLS or i in starts and m[2] == starts[i]["name"]:
                continue
            calls.append({"caller_qname": caller["qualified_name"], "callee_name": m[2], "callee_qualifier": re.sub(r"\s", "", m[1]) + m[2], "arguments": [], "line_number": i + 1,
                          "result_var_qname": None, "shadowed": False})
    imports = [m[1] for line in lines for p in spec.imports for m in re.finditer(p, line, spec.flags)]
    return {"path": path, "language": language, "error": None, "symbols": symbols, "imports": imports, "bindings": [], "calls": calls, "variables": [], "flows": []}
