"""Evidence of one Python file, by the standard library's syntax and symbol tables."""

from __future__ import annotations

import ast
import symtable
from collections.abc import Iterator

from ..functions.paths import module_name

FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)
COMPREHENSION = (ast.ListComp, ast.SetComp, ast.GeneratorExp, ast.DictComp)


def stored(node: ast.AST) -> set[str]:
    """Names anywhere in a target."""
    return {n.id for n in ast.walk(node) if isinstance(n, ast.Name)}


def arguments(args: ast.arguments) -> list[tuple[ast.arg, str, bool]]:
    """(argument, kind, whether it has a default) in order of declaration."""
    plain = [*args.posonlyargs, *args.args]
    given = len(plain) - len(args.defaults)
    out = [(a, "positional_only" if i < len(args.posonlyargs) else "positional_or_keyword", i >= given) for i, a in enumerate(plain)]
    out += [(args.vararg, "var_positional", False)] if args.vararg else []
    out += [(a, "keyword_only", d is not None) for a, d in zip(args.kwonlyargs, args.kw_defaults, strict=True)]
    return out + ([(args.kwarg, "var_keyword", False)] if args.kwarg else [])


def inside(node: ast.AST | None, hidden: frozenset[str] = frozenset()) -> Iterator[tuple[ast.AST, frozenset[str]]]:
    """Nodes of an expression or statement that belong to its own scope, each with the names that comprehensions and lambdas around it hide."""
    if node is None:
        return
    yield node, hidden
    if isinstance(node, (*FUNCTION, ast.ClassDef)):
        outer = [*node.decorator_list, *([*node.args.defaults, *filter(None, node.args.kw_defaults)] if isinstance(node, FUNCTION) else [*node.bases, *(k.value for k in node.keywords)])]
        for child in outer:
            yield from inside(child, hidden)
    elif isinstance(node, ast.Lambda):
        for child in [*node.args.defaults, *filter(None, node.args.kw_defaults)]:
            yield from inside(child, hidden)
        yield from inside(node.body, hidden | {a.arg for a, _, _ in arguments(node.args)})
    elif isinstance(node, COMPREHENSION):
        within = hidden
        for i, part in enumerate(node.generators):
            yield from inside(part.iter, hidden if i == 0 else within)
            within = within | stored(part.target)
            for test in part.ifs:
                yield from inside(test, within)
        for child in [node.key, node.value] if isinstance(node, ast.DictComp) else [node.elt]:
            yield from inside(child, within)
    else:
        for child in ast.iter_child_nodes(node):
            yield from inside(child, hidden)


def reads(node: ast.AST | None, hidden: frozenset[str] = frozenset()) -> list[str]:
    return sorted({n.id for n, h in inside(node, hidden) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load) and n.id not in h})


class Scope:
    def __init__(self, node: ast.AST, table: symtable.SymbolTable, qname: str, parent: Scope | None):
        self.node, self.table, self.qname, self.parent = node, table, qname, parent

    def owner(self, name: str) -> str:
        """Qualified name of the scope that a name of this scope lives in."""
        try:
            symbol = self.table.lookup(name)
        except KeyError:
            return self.qname
        if symbol.is_free() and self.parent is not None:
            up = self.parent
            while up is not None:
                if up.table.get_type() == "function" and name in up.table.get_identifiers() and up.table.lookup(name).is_local():
                    return up.qname
                up = up.parent
        if symbol.is_declared_global() or symbol.is_global() and not symbol.is_local():
            top = self
            while top.parent is not None:
                top = top.parent
            return top.qname if name in top.table.get_identifiers() and top.table.lookup(name).is_assigned() else self.qname
        return self.qname

    def variable(self, name: str) -> str:
        return f"{self.owner(name)}:{name}"


def scopes(tree: ast.Module, table: symtable.SymbolTable, module: str) -> Iterator[Scope]:
    """The module's scope and those of all classes and functions, outer ones first."""
    def children(scope: Scope) -> Iterator[Scope]:
        tables = {}
        stack = list(scope.table.get_children())
        while stack:
            t = stack.pop(0)
            if t.get_type() in ("function", "class") and t.get_name() not in ("lambda", "listcomp", "setcomp", "dictcomp", "genexpr"):
                tables.setdefault((t.get_name(), t.get_lineno()), t)
            else:
                stack += t.get_children()
        for stmt in scope.node.body:
            for node, _ in inside(stmt):
                if isinstance(node, (*FUNCTION, ast.ClassDef)):
                    at = node.lineno
                    own = tables.get((node.name, at)) or next((t for (n, _), t in tables.items() if n == node.name), None)
                    if own is None:
                        continue
                    inner = Scope(node, own, f"{scope.qname}.{node.name}", scope)
                    yield inner
                    yield from children(inner)

    top = Scope(tree, table, module, None)
    yield top
    yield from children(top)


def absolute(module: str, path: str, node: ast.ImportFrom) -> str:
    """Module of a from-import; leading dots count from the file's package."""
    if not node.level:
        return node.module or ""
    parts = module.split(".")
    package = parts if path.endswith("__init__.py") and parts[-1:] != ["__init__"] else parts[:-1]
    kept = package[: len(package) - node.level + 1]
    return ".".join([*kept, *([node.module] if node.module else [])])


def extract(path: str, text: str) -> dict:
    """symbols, imports, calls, variables and flows of a file; a file that can't be parsed has an error and nothing else."""
    out: dict = {"path": path, "language": "python", "error": None, "symbols": [], "imports": [], "bindings": [], "calls": [], "variables": [], "flows": []}
    try:
        tree, table = ast.parse(text), symtable.symtable(text, path, "exec")
    except (SyntaxError, ValueError, RecursionError) as e:
        return out | {"error": str(e)}
    variables: dict[str, dict] = {}

    def variable(scope_qname: str, name: str, line: int, role: str, index: int | None = None) -> str:
        key = f"{scope_qname}:{name}"
        own = variables.setdefault(key, {"qualified_name": key, "name": name, "scope_qname": scope_qname, "line_number": line, "role": role, "parameter_index": index})
        if own["role"] == "local" and role == "parameter":
            own["role"] = role
        return key

    every = list(scopes(tree, table, module_name(path)))
    for scope in every:
        node = scope.node
        if isinstance(node, ast.Module):
            continue
        if isinstance(node, ast.ClassDef):
            kind, parameters = "class", None
        else:
            kind = ("async_" if isinstance(node, ast.AsyncFunctionDef) else "") + ("method" if isinstance(scope.parent.node, ast.ClassDef) else "function")
            parameters = [{"name": a.arg, "kind": k, "has_default": d} for a, k, d in arguments(node.args)]
            variable(scope.qname, "__return__", node.lineno, "return")
            for i, (a, _, _) in enumerate(arguments(node.args)):
                variable(scope.qname, a.arg, a.lineno, "parameter", i)
        out["symbols"].append({"qualified_name": scope.qname, "name": node.name, "symbol_type": kind, "line_start": node.lineno, "line_end": node.end_lineno, "parameters": parameters})
    flows: dict[tuple, None] = {}
    for scope in every:
        parents = {}
        for stmt in scope.node.body:
            for node, hidden in inside(stmt):
                for child in ast.iter_child_nodes(node):
                    parents.setdefault(child, node)
                if isinstance(node, ast.Import):
                    out["imports"] += [a.name for a in node.names]
                    out["bindings"] += [{"scope_qname": scope.qname, "name": a.asname or a.name.split(".")[0], "target": a.name if a.asname else a.name.split(".")[0]} for a in node.names]
                elif isinstance(node, ast.ImportFrom):
                    base = absolute(module_name(path), path, node)
                    out["imports"] += [base] if base else []
                    out["bindings"] += [{"scope_qname": scope.qname, "name": a.asname or a.name, "target": f"{base}.{a.name}" if base else a.name} for a in node.names if a.name != "*"]
                if not isinstance(scope.node, FUNCTION):
                    continue
                role = lambda name: "parameter" if variables.get(scope.variable(name), {}).get("role") == "parameter" else "local"  # noqa: E731, B023
                if isinstance(node, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
                    targets = sorted(set().union(*map(stored, node.targets if isinstance(node, ast.Assign) else [node.target])))
                    sources = sorted({*reads(node.value, hidden), *(targets if isinstance(node, ast.AugAssign) else ())})
                    for t in targets:
                        to = variable(scope.owner(t), t, node.lineno, "local")
                        for s in sources:
                            frm = variable(scope.owner(s), s, node.lineno, role(s))
                            if frm != to:
                                flows[frm, to, scope.qname, node.lineno, "assignment"] = None
                elif isinstance(node, ast.Return):
                    for s in reads(node.value, hidden):
                        flows[variable(scope.owner(s), s, node.lineno, role(s)), f"{scope.qname}:__return__", scope.qname, node.lineno, "return"] = None
                elif isinstance(node, ast.Call):
                    given = [*node.args, *(k.value for k in node.keywords)]
                    for s in {n for a in given for n in reads(a, hidden)}:
                        variable(scope.owner(s), s, node.lineno, role(s))
                    name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None
                    if name is None:
                        continue
                    parent = parents.get(node)
                    result = None
                    if isinstance(parent, ast.Assign):
                        result = next((t.id for t in parent.targets if isinstance(t, ast.Name)), None)
                    elif isinstance(parent, ast.AnnAssign) and isinstance(parent.target, ast.Name):
                        result = parent.target.id
                    elif isinstance(parent, ast.Return):
                        result = "__return__"
                    qualifier = ast.unparse(node.func)
                    slots = [{"dependencies": [scope.variable(n) for n in reads(a, hidden)], "position": i, "keyword": None, "unpacked": isinstance(a, ast.Starred)} for i, a in enumerate(node.args)]
                    slots += [{"dependencies": [scope.variable(n) for n in reads(k.value, hidden)], "position": None, "keyword": k.arg, "unpacked": k.arg is None} for k in node.keywords]
                    out["calls"].append({"caller_qname": scope.qname, "callee_name": name, "callee_qualifier": qualifier, "arguments": slots, "line_number": node.lineno,
                                         "result_var_qname": None if result is None else f"{scope.qname}:__return__" if result == "__return__" else scope.variable(result),
                                         "shadowed": qualifier.split(".")[0] in hidden})
    out["variables"] = list(variables.values())
    out["flows"] = [dict(zip(("src", "dst", "scope_qname", "line_number", "flow_type"), f, strict=True)) for f in flows]
    return out
