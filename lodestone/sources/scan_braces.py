"""Items of JavaScript, TypeScript, Rust, C and C++ files: a scanner of strings, comments and braces.

The text is masked first (comments, strings and the like become blanks of the
same length); statements are then cut where brackets balance, and named by what
they begin with.
"""

from __future__ import annotations

import re

from lodestone.sources.items import CLASS, COMMENT, DATA, FIELD_FUNCTION, FUNCTION, OTHER, SKIPPED, Item

JS, RUST, C, CPP = "js", "rust", "c", "cpp"
_TOKENS = {
    JS: re.compile(r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(?P<regex>(?<=[(,=:\[!&|?{};])\s*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n])+/)", re.S),
    RUST: re.compile(r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z)|\#!?\[(?:[^\[\]\"]|\"(?:\\.|[^\"\\])*\"|\[[^\]]*\])*\])|(?P<string>r(#*)\".*?\"\4|\"(?:\\.|[^\"\\])*\"|'(?:\\[^']+|[^\\'])')".replace(r"\4", r"(?P=h)").replace("r(#*)", "r(?P<h>#*)"), re.S),
    C: re.compile(r"(?P<comment>//(?:\\\n|[^\n])*|/\*.*?(?:\*/|\Z))|(?P<string>R\"(?P<d>[^(\s]*)\(.*?\)(?P=d)\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+')", re.S),
}
_TOKENS[CPP] = _TOKENS[C]
#: A fixed value: macros that mark exported classes.
_EXPORT = re.compile(r"\b(class|struct)(\s+)([A-Z_][A-Z0-9_]*_API)\b")
_DIRECTIVE = re.compile(r"[ \t]*#[ \t]*(\w+)(?:\\\n|[^\n])*")
_WORD = r"[A-Za-z_$][\w$]*"

_RUST_HEAD = re.compile(rf"(?:pub(?:\s*\([^)]*\))?\s+)?(?:(?:default|async|unsafe|extern(?:\s*\"[^\"]*\")?|const(?=\s+(?:unsafe|extern|async|fn)))\s+)*(?P<word>fn|struct|enum|union|trait|mod|impl|use|const|static)\b\s*(?:mut\s+)?(?P<name>{_WORD})?")
_JS_FUNCTION = re.compile(rf"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>{_WORD})?")
_JS_CLASS = re.compile(rf"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\b\s*(?P<name>(?!extends\b|implements\b){_WORD})?")
_JS_BINDING = re.compile(rf"(?:export\s+)?(?:const|let|var)\s+(?P<name>{_WORD})?")
_FUNCTION_VALUE = re.compile(rf"(?:async\s+)?(?:function\b|\*?\s*\((?:[^()]|\([^()]*\))*\)\s*(?::[^=]+)?=>|{_WORD}\s*=>|<[^>]*>\s*\()")
_JS_METHOD = re.compile(rf"(?:(?:public|private|protected|static|readonly|override|abstract|async|get|set)\s+)*\*?\s*(?P<name>#?{_WORD})\s*(?:<[^>]*>)?\s*\(")
_JS_FIELD = re.compile(rf"(?:(?:public|private|protected|static|readonly|override|declare)\s+)*(?P<name>#?{_WORD})\s*[?!]?\s*(?::[^=]+)?=(?!=)\s*")
_JS_PLAIN = re.compile(r"(?:if|for|while|do|switch|try|return|throw|break|continue|debugger|interface|type|enum|namespace|module|declare|export|label)\b")
_C_NAME = re.compile(r"((?:[A-Za-z_]\w*\s*(?:<[^<>()]*>)?\s*::\s*)*(?:~\s*[A-Za-z_]\w*|operator\s*(?:\(\s*\)|\[\s*\]|[^\s\w(]+|\s\w+)|[A-Za-z_]\w*))\s*\(")
_C_AGGREGATE = re.compile(r"(?P<typedef>typedef\s+)?(?:(?:static|const|extern|inline)\s+)*(?P<word>class|struct|union|enum(?:\s+(?:class|struct))?|namespace)\b\s*(?:\[\[[^\]]*\]\]|alignas\([^)]*\))?\s*(?P<name>[A-Za-z_]\w*(?:::\w+)*)?")
#: A definition whose parameters are declared between its head and its body.
_OLD_STYLE = re.compile(r"(?!(?:if|for|while|switch|return|else|do|typedef)\b)[A-Za-z_][\w\s*]*\(\s*\w+(?:\s*,\s*\w+)*\s*\)\s*(?:[A-Za-z_][\w\s*,\[\]]*+;\s*+)++\{")
_ACCESS = re.compile(r"(?:public|private|protected|signals|slots)\s*(?:slots\s*)?:(?!:)")


def _nested_end(text: str, at: int) -> int:
    """The offset behind a comment that may hold others of its kind."""
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(text, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return len(text)


def _one_head(mask: str) -> str:
    """``mask`` with one branch of each conditional whose branches all open (or close) the same braces: they are heads of one body."""
    open_: list[list[tuple[int, int]]] = []  # for each conditional its branches, the last one unfinished
    for m in _DIRECTIVE.finditer(mask):
        word = m[1]
        if word in ("if", "ifdef", "ifndef"):
            open_.append([(m.end(), m.end())])
        elif open_ and word in ("elif", "elifdef", "elifndef", "else", "endif"):
            branches = open_[-1]
            branches[-1] = branches[-1][0], m.start()
            if word != "endif":
                branches.append((m.end(), m.end()))
                continue
            open_.pop()
            nets = {mask.count("{", a, b) - mask.count("}", a, b) for a, b in branches}
            if len(branches) > 1 and len(nets) == 1 and nets != {0}:
                for a, b in branches[1:]:
                    mask = mask[:a] + re.sub(r"[^\n]", " ", mask[a:b]) + mask[b:]
    return mask


class Scanner:
    def __init__(self, text: str, language: str) -> None:
        self.language = language
        self.text = _EXPORT.sub(lambda m: m[1] + m[2] + " " * len(m[3]), text) if language in (C, CPP) else text
        self.comments: list[Item] = []
        masked, at = [], 0
        while m := _TOKENS[language].search(self.text, at):
            end = _nested_end(self.text, m.start()) if language == RUST and m[0].startswith("/*") else m.end()
            masked.append(self.text[at : m.start()])
            blank = re.sub(r"[^\n]", " ", self.text[m.start() : end])
            if m["comment"]:
                self.comments.append(Item(COMMENT, m.start(), end))
            else:
                # a string stays recognisable as a value
                blank = '"' + blank[1:-1] + '"' if len(blank) > 1 else blank
            masked.append(blank)
            at = end
        self.mask = "".join([*masked, self.text[at:]])
        if language in (C, CPP):
            self.mask = _one_head(self.mask)

    # -- structure ---------------------------------------------------------------------------

    def close(self, at: int) -> int:
        """The offset behind the bracket that closes the one at ``at``."""
        depth, mask = 0, self.mask
        for i in range(at, len(mask)):
            c = mask[i]
            if c in "([{":
                depth += 1
            elif c in ")]}":
                depth -= 1
                if depth <= 0:
                    return i + 1
        return len(mask)

    def items(self, start: int, end: int, inside: str = "") -> list[Item]:
        """The items between two offsets; ``inside``: the word that opened the body, if any."""
        out, at, mask = [], start, self.mask
        while at < end:
            c = mask[at]
            if c.isspace() or c in ";)}],":
                at += 1
                continue
            if self.language in (C, CPP) and c == "#":
                m = _DIRECTIVE.match(mask, at)
                if m:
                    if m[1] == "define":
                        name = re.match(r"\s*#\s*define\s+(\w+)", m[0])
                        out.append(Item(DATA, at, m.end(), name[1] if name else None))
                    elif m[1] == "include":
                        out.append(Item(SKIPPED, at, m.end()))
                    at = m.end()
                    continue
            access = _ACCESS.match(mask, at) if inside and self.language == CPP else None
            if access:
                out.append(Item(OTHER, at, access.end()))
                at = access.end()
                continue
            made, at = self.statement(at, end, inside)
            out.extend(made)
        own = [x for x in self.comments if start <= x.start < end and not any(i.start <= x.start < i.end for i in out)]
        return sorted([*out, *own], key=lambda x: x.start)

    def statement(self, start: int, end: int, inside: str) -> tuple[list[Item], int]:
        """The item that begins at ``start`` (or those a transparent one holds), and where the next may begin."""
        mask, at, body = self.mask, start, None
        equals = paren = False
        old = _OLD_STYLE.match(mask, start, end) if self.language == C and not inside else None
        if old:
            stop = min(end, self.close(old.end() - 1))
            return self.name(start, stop, old.end() - 1, False, True, inside), stop
        while at < end:
            c = mask[at]
            if c == ";":
                at += 1
                break
            if c == "=" and mask[at : at + 2] not in ("==", "=>") and mask[at - 1] not in "=!<>" and "operator" not in mask[max(start, at - 12) : at]:
                equals = True
            elif c in "([":
                paren = paren or c == "("
                at = self.close(at)
                continue
            elif c == "{":
                if body is None:
                    body = at
                at = self.close(at)
                if self.ends_at_brace(mask[start:body], equals, inside, at):
                    break
                continue
            elif c in ")]}":
                break
            elif c == "\n" and self.language == JS and self.breaks(start, at, end):
                break
            at += 1
        at = min(at, end)
        stop = start + len(mask[start:at].rstrip())
        if stop <= start:
            return [], max(at, start + 1)
        return self.name(start, stop, body if body is not None and body < stop else None, equals, paren, inside), at

    def ends_at_brace(self, head: str, equals: bool, inside: str, after: int) -> bool:
        if self.language == RUST:
            return not equals or re.match(r"\s*(?:pub\b.*?)?(?:fn|impl|trait|mod)\b", head, re.S) is not None
        if self.language in (C, CPP):
            m = _C_AGGREGATE.match(re.sub(r"^template\s*<[^{]*?>\s*", "", head.strip()))
            aggregate = bool(m) and m["word"] != "namespace" and "(" not in head
            return not equals and not aggregate
        if re.match(r"\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function|(?:abstract\s+)?class)\b", head):
            return True
        if inside:
            return not equals
        follows = re.match(r"\s*(else|catch|finally|while)\b", self.mask[after : after + 40])
        return bool(_JS_PLAIN.match(head.strip())) and not equals and not follows

    def breaks(self, start: int, at: int, end: int) -> bool:
        """Whether a JavaScript statement ends at this line break."""
        before, after = self.mask[start:at].rstrip(), self.mask[at:end].lstrip()
        if not before or before[-1] in "=+-*/%&|^!?:,.<>~(" or before.endswith((" extends", " implements", " of", " in")) or before.endswith("=>") and not before.endswith("}"):
            return False
        if not before.endswith("}") and re.match(r"(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function|(?:abstract\s+)?class)\b", before):
            return False
        return not after.startswith((".", "?", ":", "+", "-", "*", "/", "%", "&", "|", "=", ",", "(", "[", "`", "{", "<", ">"))

    # -- names -------------------------------------------------------------------------------

    def name(self, start: int, stop: int, body: int | None, equals: bool, paren: bool, inside: str) -> list[Item]:
        head = self.mask[start : body if body is not None else stop]
        return getattr(self, f"_{'c' if self.language == CPP else self.language}")(start, stop, body, head, equals, inside)

    def container(self, start: int, stop: int, body: int, name: str | None, word: str) -> Item:
        return Item(CLASS, start, stop, name, body, self.items(body + 1, self.close(body) - 1, word))

    def _rust(self, start: int, stop: int, body: int | None, head: str, equals: bool, inside: str) -> list[Item]:
        m = _RUST_HEAD.match(head)
        if not m:
            return [Item(OTHER, start, stop)]
        word, name = m["word"], m["name"]
        if word == "fn":
            return [Item(FUNCTION if body is not None or inside else OTHER, start, stop, name)]
        if word == "use":
            return [Item(SKIPPED, start, stop)]
        if word in ("const", "static"):
            return [Item(DATA, start, stop, name)]
        if word == "impl":
            said = head[m.end("word") :].split(" where ")[0].strip()
            if said.startswith("<"):
                depth = 0
                for i, c in enumerate(said):
                    depth += (c == "<") - (c == ">" and said[i - 1] != "-")
                    if not depth:
                        said = said[i + 1 :].strip()
                        break
            name = re.sub(r"\s+", " ", said)
        if body is None:
            # a tuple struct has its fields in the head
            return [Item(CLASS, start, stop, name, start + head.index("("))] if word == "struct" and "(" in head else [Item(OTHER, start, stop)]
        return [self.container(start, stop, body, name, word)]

    def _js(self, start: int, stop: int, body: int | None, head: str, equals: bool, inside: str) -> list[Item]:
        whole = self.mask[start:stop]
        if inside:
            member = _JS_METHOD.match(whole)
            if member and body is not None and not equals and member["name"] not in ("if", "for", "while", "switch"):
                return [Item(FUNCTION, start, stop, member["name"])]
            value = _JS_FIELD.match(whole)
            if value and _FUNCTION_VALUE.match(whole[value.end() :]):
                return [Item(FIELD_FUNCTION, start, stop, value["name"])]
            return [Item(OTHER, start, stop)]
        if re.match(r"import\b(?!\s*\()", whole):
            return [Item(SKIPPED, start, stop)]
        m = _JS_FUNCTION.match(whole)
        if m and body is not None:
            return [Item(FUNCTION, start, stop, m["name"])]
        m = _JS_CLASS.match(whole)
        if m and body is not None:
            return [self.container(start, stop, body, m["name"], "class")]
        m = _JS_BINDING.match(whole)
        if m:
            value = re.compile(r"\s*(?::[^=]+)?=(?!=)\s*").match(whole, m.end()) if m["name"] else None
            if value and _FUNCTION_VALUE.match(whole[value.end() :]) and not self._several(whole[value.end() :]):
                return [Item(FUNCTION, start, stop, m["name"])]
            return [Item(DATA, start, stop, m["name"])]
        if _JS_PLAIN.match(whole) or body is not None and whole.startswith("{"):
            return [Item(OTHER, start, stop)]
        bound = re.match(rf"({_WORD})\s*(?:[-+*/%&|^]|\*\*|<<|>>>?|&&|\|\||\?\?)?=(?!=)", whole)
        return [Item(DATA, start, stop, bound[1] if bound else None)]

    @staticmethod
    def _several(value: str) -> bool:
        """Whether a further binding follows a function value."""
        value = re.sub(r"^(?:async\s+)?<[^()]*>(?=\s*\()", "", value)  # type parameters have commas too
        depth = 0
        for c in value:
            depth += (c in "([{") - (c in ")]}")
            if c == "," and not depth:
                return True
        return False

    def _c(self, start: int, stop: int, body: int | None, head: str, equals: bool, inside: str) -> list[Item]:
        plain = re.match(r"\s*(?:template\s*<(?:[^<>{}]|<[^<>{}]*>)*>\s*)*", head).end()
        said = head[plain:]
        if re.match(r'extern\s+"', said) and body is not None and "(" not in said:
            return [x for x in self.items(body + 1, self.close(body) - 1) if x.kind != COMMENT]
        m = _C_AGGREGATE.match(said)
        if m and body is not None and "(" not in said and not equals:
            name = m["name"] if m["name"] not in ("final",) else None
            if m["typedef"]:
                after = re.match(r"[\s*]*([A-Za-z_]\w*)", self.mask[self.close(body) : stop])
                name = after[1] if after else name
            return [self.container(start, stop, body, name, m["word"])]
        if re.match(r"using\b", said):
            alias = re.match(r"using\s+(\w+)\s*=", said)
            return [Item(DATA, start, stop, alias[1]) if alias else Item(SKIPPED, start, stop)]
        called = _C_NAME.search(said)
        if body is not None and called and not equals:
            return [Item(FUNCTION, start, stop, re.sub(r"\s*(::|~)\s*", r"\1", called[1].strip()))]
        if re.match(r"(?:if|for|while|do|switch|return|goto|case|default|else)\b", said) or inside and not called:
            return [Item(OTHER, start, stop)]
        if self.language == C and re.search(r"\)\s*[A-Z_][A-Z0-9_]*\s*\(", said):
            return [Item(OTHER, start, stop)]
        if called and re.fullmatch(r"\s*[A-Za-z_]\w*\s*\(.*\)\s*;?", said, re.S) and called.start() <= len(said) - len(said.lstrip()):
            return [Item(DATA, start, stop)]
        if called and not equals:
            return [Item(DATA, start, stop, called[1].strip())]
        bound = re.search(r"([A-Za-z_]\w*(?:::\w+)*)\s*(?:\[[^\]]*\]\s*)*(?:=|;|,|$)", said)
        return [Item(DATA, start, stop, bound[1] if bound else None)]


def items_of(text: str, language: str) -> tuple[str, list[Item]]:
    """The text the offsets are of, and the file's items."""
    scanner = Scanner(text, language)
    return scanner.text, scanner.items(0, len(scanner.text))
