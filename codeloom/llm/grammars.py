"""Token tables and parsing-expression grammars of Go, Java, Python, TypeScript, JavaScript and Rust.

They cover the languages as written in practice; what needs types or scopes (duplicate names,
return outside a function, assignment to a call) is not syntax here. Generics nest to any depth,
Rust macro bodies are any balanced tokens.
"""

from __future__ import annotations

import re

from .lex import Lexer, PythonLexer
from .peg import Grammar

_C_SKIP = r"[ \t\r\f\v\n]++|//[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/"
_LINE_SKIP = r"[ \t\r\f\v]++|//[^\n]*+|/\*(?:[^*\n]|\*(?!/))*+\*/"
_NEWLINE = r"\n\s*+|/\*(?:[^*]|\*(?!/))*+\*/"
_DQ = r'"(?:[^"\\\n]|\\[\s\S])*+"'
_SQ = r"'(?:[^'\\\n]|\\[\s\S])*+'"

# ------------------------------------------------------------------ Go

GO_LEXER = Lexer(
    _LINE_SKIP,
    [_DQ, r"`[^`]*+`", r"'(?:[^'\\\n]|\\[^\n])[^'\n]*+'"],
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package"
    " range return select struct switch type var",
    "+ - * / % & | ^ << >> &^ && || == != < <= > >= = += -= *= /= %= &= |= ^= <<= >>= &^= := ++ -- <- ! ~ . , : ; ...",
    newline=_NEWLINE, marks=False,
)
_GO = r"""
str = STR / TPL
tpre = '*' / @arr / 'map' @targ / 'chan' '<-'? / '<-' 'chan' / 'func' @params &tstart
tstart = ID / '*' / @arr / 'map' / 'chan' / '<-' / 'func' / 'struct' / 'interface'
tbase = 'func' @params @params? / 'struct' @fields / 'interface' @methods / ID ('.' ID)? @targ? / @paren
type = tpre* tbase
sig = @params (@params / type)?
lits = ('map' @targ / @arr / 'chan' '<-'? / '<-' 'chan')+ tpre* tbase / 'struct' @fields / 'interface' @methods
core = NUM / str / ID / @paren / 'func' sig @block? / lits
un = '+' / '-' / '!' / '^' / '*' / '&' / '<-' / '~'
bin = '+' / '-' / '*' / '/' / '%' / '&' / '|' / '^' / '<<' / '>>' / '&^' / '&&' / '||' / '==' / '!=' / '<' / '<=' / '>' / '>='
post0 = '.' (ID / @paren / @assert) / @idx / @args
post = post0 / @lit
expr = un* core post* (bin un* core post*)*
core0 = NUM / str / ID / @paren / 'func' sig @block / lits @lit?
expr0 = un* core0 post0* (bin un* core0 post0*)*
exprs = expr (',' expr)*
exprs0 = expr0 (',' expr0)*
set = '=' / ':=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '&^='
simple = exprs (set exprs / '++' / '--' / '<-' expr)?
simple0 = exprs0 (set exprs0 / '++' / '--' / '<-' expr0)?
ids = ID (',' ID)*
value = ids (type ('=' exprs)? / '=' exprs)?
alias = ID @tparams? '='? type
decl = 'var' (@values / value) / 'const' (@values / value) / 'type' (@types / alias)
head = (simple0? ';')? expr0
ifs = 'if' head @block ('else' 'if' head @block)* ('else' @block)?
loop = 'for' ((exprs0 ('=' / ':='))? 'range' expr0 / simple0? ';' expr0? ';' simple0? / expr0)? @block
stmt = decl / 'return' exprs? / ifs / loop / 'switch' (simple0? ';')? simple0? @cases / 'select' @cases / ('go' / 'defer') expr / ('break' / 'continue') ID? / 'goto' ID / 'fallthrough' / @block / ID ':' !'=' / simple
part = ';' / ID ':' / stmt &(';' / END)
stmts = part*
case = ('case' (simple / type) (',' (expr / type))* / 'default') ':' / part
spec = ('.' / ID)? str
field = (ids type / '*'? ID ('.' ID)? @targ?) str?
meth = ID sig / '~'? type ('|' '~'? type)*
elem = (expr / @lit) (':' (expr / @lit))?
param = ID '...'? type / '...' type / type
args = ((expr '...'? / type) (',' (expr '...'? / type))* ','?)?
paren = expr / type
assert = 'type'
params = (param (',' param)* ','?)?
imports = (spec ';'+)* spec?
values = (value ';'+)* value?
types = (alias ';'+)* alias?
arr = ('...' / expr)?
idx = expr? ':' expr? (':' expr)? / (expr / type) (',' (expr / type))* ','?
targ = type (',' type)* ','?
tparam = ids '~'? type ('|' '~'? type)*
tparams = tparam (',' tparam)* ','?
lit = (elem (',' elem)* ','?)?
fields = (field ';'+)* field?
methods = (meth ';'+)* meth?
cases = ';'* (&('case' / 'default') / END) case*
func = 'func' @params? ID @tparams? sig @block?
top = ';' / ('import' (@imports / spec) / func / decl) &(';' / END)
file = ';'* 'package' ID &(';' / END) top*
"""
GO = Grammar(_GO, GO_LEXER.tokens, {
    "(": {r: r for r in ("args", "paren", "assert", "params", "imports", "values", "types")},
    "[": {r: r for r in ("arr", "idx", "targ", "tparams")},
    "{": {"block": "stmts", "lit": "lit", "fields": "fields", "methods": "methods", "cases": "cases"},
}, "file", "; :")

# ------------------------------------------------------------------ Java

JAVA_LEXER = Lexer(
    _C_SKIP,
    [r'"""[\s\S]*?"""', _DQ, r"'(?:[^'\\\n]|\\[^\n])[^'\n]*+'"],
    "abstract assert break case catch class const continue default do else enum extends final finally for goto if implements"
    " import instanceof interface native new package private protected public return static strictfp super switch synchronized"
    " this throw throws transient try volatile while yield",
    "+ - * / % & | ^ ~ ! < > <= >= == != && || ++ -- = += -= *= /= %= &= |= ^= <<= ? : :: -> . , ; ... @",
    letters="$",
)
_JAVA = r"""
qname = ID ('.' ID)*
ann = '@' qname @args?
tn = ann* ID ta? ('.' ID ta?)* (ann* @dim)*
tw = ann* '?' (('extends' / 'super') tn)? / tn
ta = '<' (tw (',' tw)*)? '>'
type = ann* ID ta? ('.' ann* ID ta?)* (ann* @dim)*
types = type (',' type)*
tp1 = ann* ID ('extends' type ('&' type)*)?
tps = '<' tp1 (',' tp1)* '>'
lam = (ID / @lparams) '->'
un = '+' / '-' / '!' / '~' / '++' / '--'
pre = lam !@block / un / @cast &(ID / NUM / STR / @args / '!' / '~' / 'new' / 'this' / 'super' / 'switch' / @cast / @lparams)
made = ann* ID ta? ('.' ID ta?)*
new = 'new' made ((@idx / @dim)+ @arrinit? / @args @cbody?)
core = NUM / STR / new / ID ta (@dim)* &'::' / ID / 'this' / 'super' / @args / 'switch' @args @sblock
post = '.' (ID / 'this' / 'super' / 'class' / new / ta ID) / @args / @idx / @dim / '++' / '--' / '::' ta? (ID / 'new')
operand = pre* (lam @block / core post*)
shift = '<' '<' / '>' '>' '>=' / '>' '>=' / '>' '>' '>' / '>' '>'
bin = shift / '+' / '-' / '*' / '/' / '%' / '&' / '|' / '^' / '<=' / '>=' / '<' / '>' / '==' / '!=' / '&&' / '||' / '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<='
isa = 'instanceof' 'final'? type (ID / @args ID?)?
flat = operand (isa / bin operand)*
expr = flat ('?' expr ':' flat)*
init = @arrinit / expr
exprs = expr (',' expr)*
var = ID @dim* ('=' init)?
vars = ('final' / ann)* type var (',' var)*
body = ifs / loop / ID ':' !':' body / @block / simple
ifs = 'if' @args body ('else' 'if' @args body)* ('else' body)?
label = 'case' lab (',' lab)* ('if' expr)? / 'default'
lab = '-'? NUM / STR / 'default' / made (ID / @args ID?)? 
case = label (':' / '->' (@block / 'throw' expr ';' / expr ';')) / stmt
jump = 'return' expr? ';' / 'throw' expr ';' / ('break' / 'continue') ID? ';' / 'assert' expr (':' expr)? ';' / 'yield' expr ';'
whole = 'do' (@block / expr ';') 'while' @args ';' / 'try' @res? @block ('catch' @catchp @block)* ('finally' @block)? / 'switch' @args @sblock / 'synchronized' @args @block
simple = ';' / jump / whole / vars ';' / expr ';'
loop = ('while' @args / 'for' @forhead) body / 'do' body 'while' @args ';'
stmt = body / mods (class / face / enum / rec)
mods = (ann / 'public' / 'private' / 'protected' / 'static' / 'final' / 'abstract' / 'native' / 'synchronized' / 'transient' / 'volatile' / 'strictfp' / 'default' / ID &('class' / 'interface' / 'abstract' / 'public' / 'static') / ID '-' ID &('class' / 'interface'))*
class = 'class' ID tps? ('extends' type)? ('implements' types)? (ID types)? @cbody
face = '@'? 'interface' ID tps? ('extends' types)? (ID types)? @cbody
enum = 'enum' ID ('implements' types)? @ebody
rec = ID ID tps? @params ('implements' types)? @cbody
throws = 'throws' types
ctor = tps? ID (@params throws? @block / @block)
method = tps? ann* type ID @params @dim* throws? (@block / ('default' (ann / init))? ';')
member = ';' / mods (class / face / enum / method / ctor / @block / rec / type var (',' var)* ';')
const = ann* ID @args? @cbody?
args = (arg (',' arg)* ','?)?
arg = ID '=' (@arrinit / ann) / ann / @arrinit / expr
cast = type ('&' type)*
param = ('final' / ann)* type ann* '...'? (ID / 'this' / ID '.' 'this') @dim*
params = (param (',' param)*)?
lparams = (ID (',' ID)*)? !ID / params
forhead = (vars / exprs)? ';' expr? ';' exprs? / ('final' / ann)* type ID ':' expr
catchp = ('final' / ann)* type ('|' type)* ID
res = (vars / expr) (';' (vars / expr))* ';'?
dim = !ID
idx = expr
block = stmt*
cbody = member*
arrinit = ((@arrinit / ann / expr) (',' (@arrinit / ann / expr))*)? ','?
sblock = (&('case' / 'default') / END) case*
ebody = (const (',' const)* ','?)? (';' / END) member*
import = 'import' 'static'? ID ('.' ID)* ('.' '*')? ';'
top = ';' / import / mods (class / face / enum / rec)
file = (ann* 'package' qname ';')? top*
"""
JAVA = Grammar(_JAVA, JAVA_LEXER.tokens, {
    "(": {r: r for r in ("args", "cast", "params", "lparams", "forhead", "catchp", "res")},
    "[": {"dim": "dim", "idx": "idx"},
    "{": {r: r for r in ("block", "cbody", "arrinit", "sblock", "ebody")},
}, "file", "; :")

# ------------------------------------------------------------------ Python

PYTHON_LEXER = PythonLexer(
    r"[ \t\f\v\r]++|#[^\n]*+|\\\r?\n",
    [r"type[ \t]+(?=(?!(?:in|is|and|or|not|if|else|for|as)\b)[^\W\d]\w*+[ \t]*(?:\[|=(?!=)))", r"(?i:[rbuft]{0,2})(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*+\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*+'''|" + _DQ + "|" + _SQ + ")"],
    "and as assert async await break class continue def del elif else except finally for from global if import in is lambda"
    " nonlocal not or pass raise return try while with yield",
    "+ - * ** / // % @ << >> & | ^ ~ := < > <= >= == != -> += -= *= /= //= %= @= &= |= ^= >>= <<= **= . , : ; = ... !",
    newline=r"\n(?:[ \t\f\v\r]*+(?:#[^\n]*+)?\n)*+[ \t\f\v]*+",
)
_PYTHON = r"""
str = STR
lamp = ('*' / '**')? ID ('=' expr)? / '*' / '/'
un = '+' / '-' / '~' / 'not' / 'await' / 'lambda' (lamp (',' lamp)* ','?)? ':'
core = ID / NUM / str+ / '...' / @tuple / @list / @dict
post = '.' ID / @args / @idx
bin = '+' / '-' / '*' / '**' / '/' / '//' / '%' / '@' / '<<' / '>>' / '&' / '|' / '^' / '<' / '>' / '<=' / '>=' / '==' / '!=' / 'in' / 'not' 'in' / 'is' 'not'? / 'and' / 'or'
or = un* core post* (bin un* core post*)*
expr = or ('if' or 'else' or)*
star = '*' or / expr
named = ID ':=' expr / expr
snamed = '*' or / named
exprs = star (',' star)* ','?
tgt = '*'? (core (@args* ('.' ID / @idx))+ / ID / @tuple / @list) !@args
tgts = tgt (',' tgt)* ','?
comp = ('async'? 'for' tgts 'in' or ('if' (ID ':=' or / or))*)+
yield = 'yield' ('from' expr / exprs)?
dotted = ID ('.' ID)*
name = ID ('as' ID)?
aug = '+=' / '-=' / '*=' / '/=' / '//=' / '%=' / '@=' / '&=' / '|=' / '^=' / '>>=' / '<<=' / '**='
assign = (tgts '=')+ (yield / exprs) / tgt ':' expr ('=' (yield / exprs))? / tgt aug (yield / exprs) / yield / exprs
from = 'from' ('.' / '...')* dotted? 'import' ('*' / @names / name (',' name)*)
typed = TYPE ID @tparams? '=' expr
simple = 'pass' / typed / 'break' / 'continue' / 'return' exprs? / 'raise' (expr ('from' expr)?)? / ('global' / 'nonlocal') ID (',' ID)* / 'del' tgts / 'assert' expr (',' expr)? / 'import' dotted ('as' ID)? (',' dotted ('as' ID)?)* / from / assign
line = simple (';' simple)* ';'? NL
suite = NL @suite / line
else = 'else' ':' suite
ifs = 'if' named ':' suite ('elif' named ':' suite)* else?
while = 'while' named ':' suite else?
for = 'async'? 'for' tgts 'in' exprs ':' suite else?
fin = 'finally' ':' suite
try = 'try' ':' suite (('except' '*'? (expr (',' expr)* ('as' ID)?)? ':' suite)+ else? fin? / fin)
item = expr ('as' tgt)?
with = 'async'? 'with' (item (',' item)* ':' / @withs ':') suite
deco = '@' named NL
def = deco* 'async'? 'def' ID @tparams? @params ('->' expr)? ':' suite
class = deco* 'class' ID @tparams? @args? ':' suite
match = ID snamed (',' snamed)* ','? ':' NL @cases
stmt = ifs / while / for / try / with / def / class / match / line
args = ((arg (',' arg)* (',' karg)* (',' darg)* / karg (',' karg)* (',' darg)* / darg (',' darg)*) ','?)?
arg = '*' expr / !(ID '=') named comp?
karg = ID '=' expr / '*' expr
darg = ID '=' expr / '**' expr
tuple = (yield / named comp / snamed (',' snamed)* ','?)?
names = name (',' name)* ','?
param = ('*' / '**') ID (':' star)? / '*' / '/' / ID (':' expr)? ('=' expr)?
params = (param (',' param)* ','?)?
withs = item (',' item)* ','?
list = (named comp / snamed (',' snamed)* ','?)?
slice = expr? ':' expr? (':' expr?)? / '*' or / named
idx = slice (',' slice)* ','?
tparam = ('*' / '**')? ID (':' expr)? ('=' expr)?
tparams = tparam (',' tparam)* ','?
pair = '**' or / expr ':' expr
dict = ((expr ':' expr) comp / pair (',' pair)* ','? / named comp / snamed (',' snamed)* ','?)?
block = stmt+
pcore = ID / NUM / str+ / @tuple / @list / @dict / @pats / @pdict
pat1 = '-'? pcore ('.' ID / @args / @pats)*
pat = '*' ID / pat1 (('|' / '+' / '-') pat1)* ('as' ID)?
parg = (ID '=')? pat
pats = parg (',' parg)* ','?
ppair = '**' ID / '-'? core post* (('+' / '-') NUM)? ':' pat
pdict = ppair (',' ppair)* ','?
case = ID pat (',' pat)* ','? ('if' named)? ':' suite
cases = case+
file = NL? stmt*
"""
PYTHON = Grammar(_PYTHON, PYTHON_LEXER.tokens, {
    "(": {r: r for r in ("args", "tuple", "names", "params", "withs", "pats")},
    "[": {r: r for r in ("list", "idx", "tparams", "pats")},
    "{": {r: r for r in ("dict", "pdict")},
    "<": {"suite": "block", "cases": "cases"},
}, "file", "NL", {"pats": ("args", "tuple", "list"), "pdict": ("dict",)})

# ------------------------------------------------------------------ TypeScript and JavaScript

_TPL = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`'\"]|\"[^\"\n]*\"|'[^'\n]*'|`[^`]*`|\{[^{}`]*\})*+\})*+`"
#: What may stand before a regular expression, on its line or at the end of the line before; a division otherwise.
_BEFORE = r"[(,=:\[!&|?{};>+\-*%^~]"
_REGEX = (
    "/(?![/*])(?:" + "|".join(
        rf"(?<={before}[ \t]{{{width}}}/)" for width in range(80)
        for before in (_BEFORE, r"[(,=:\[!&|?{};>+}]\n", r"\breturn", r"\btypeof", r"\bcase", r"\bof", r"\bin")
    ) + r")(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/\w*"
)
_SOFT = (
    "async of get set static as from let type interface enum namespace module declare abstract readonly public private"
    " protected implements is keyof infer satisfies override asserts unique await yield"
)
_HARD = (
    "break case catch class const continue debugger default delete do else export extends finally for function if import in"
    " instanceof new return super switch this throw try typeof var void while with"
)
SCRIPT_LEXER = Lexer(
    _LINE_SKIP, [r"(?:using[ \t]++|accessor[ \t]++)(?=[^\W\d]|[$#])(?!(?:of|in|instanceof|as)\b(?!\s*=))|global\s++(?=\{)", _DQ, _SQ, _TPL, _REGEX], f"{_SOFT} {_HARD}",
    "+ - * / % ** & | ^ ~ ! < > <= >= == != === !== && || ?? ++ -- = += -= *= /= %= **= &= |= ^= <<= &&= ||= ??= ? ?. : => . , ; ... @",
    letters="$#", newline=_NEWLINE,
)
_quoted = " / ".join


def _script(typed: bool) -> str:
    never = "!ID ID"
    types = """tv = 'infer' id ('extends' tu)? / ID / soft / STR / TPL / 'void' / 'this' / '-'? NUM / @ttuple / @tobj / @tparen / 'import' @args
tb = tv ('.' name)* ta? (@tidx / '.' name ta?)*
tfun = 'abstract'? 'new'? tpd? @params '=>' ty
tu = tfun / ('|' / '&')? tpre* tb (('|' / '&') (tfun / tpre* tb))*
ty = tu ('is' tu)? ('extends' tu '?' ty ':' ty)?
ta = '<' ty (',' ty)* ','? '>'
type = ty
tpre = 'keyof' / 'readonly' / 'unique' / 'typeof' / 'asserts'
tpd1 = 'const'? 'in'? (ID &id)? id ('extends' ty)? ('=' ty)?
tpd = '<' tpd1 (',' tpd1)* ','? '>'
"""
    return rf"""
soft = {_quoted(f"'{w}'" for w in _SOFT.split())}
hard = {_quoted(f"'{w}'" for w in _HARD.split())}
id = ID / soft
name = ID / soft / hard
{types if typed else ""}annot = {"':' type" if typed else never}
opt = {"'?' / '!'" if typed else never}
gen = {"tpd" if typed else never}
targs = {"ta" if typed else never}
end = ';' / ASI / END
fun = 'async'? 'function' '*'? id? gen? @params annot? @block
deco = '@' (id ('.' name)* targs? @args? / @args) ASI?
class = deco* {"'abstract'?" if typed else ""} 'class' (!'extends' !'implements' id)? gen? ('extends' (id ('.' name)* targs? @args? / @args))? {"('implements' type (',' type)*)?" if typed else ""} @cbody
lam = 'async'? (id / gen? @params annot?) '=>'
core = fun / class / id / NUM / STR / TPL / 'this' / 'super' / @args / @arr / @obj / 'import' (@args / '.' name) / 'new' '.' name
un = '!' / '~' / '+' / '-' / '++' / '--' / 'typeof' / 'void' ASI? / 'delete' / 'await' !('=>' / ',' / '.') / 'yield' '*'? &(ID / NUM / STR / TPL / 'this' / @args / @arr / @obj / 'new' / 'await') / 'new' !'.' {"/ ta &(ID / 'this' / @args)" if typed else ""}
post = '.' name / '?.' (name / @args / @idx) / @args / ASI? @idx / TPL / '++' / '--' {"/ '!' !'=' / ta &(@args / TPL)" if typed else ""}
pre = lam !@block / un
operand = pre* (lam @block / core post*)
shift = '<' '<' / '>' '>' '>=' / '>' '>=' / '>' '>' '>' / '>' '>'
bin = shift / '+' / '-' / '*' / '/' / '%' / '**' / '&' / '|' / '^' / '<=' / '>=' / '<' / '>' ASI? / '==' / '!=' / '===' / '!==' / '&&' / '||' / '??' / 'in' / 'instanceof' / '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '**=' / '&=' / '|=' / '^=' / '<<=' / '&&=' / '||=' / '??='
tail = {"('as' / 'satisfies') ('const' / type) / " if typed else ""}bin operand
flat = operand tail*
expr = flat ('?' expr ':' flat)*
exprs = expr (',' expr)*
bind = (id / @obj / @arr) {"'!'?" if typed else ""} annot? ('=' expr)?
set = (id / @obj / @arr) '=' expr
var = {"('var' / 'let' / 'const' / 'await'? TYPE) bind (',' bind)*" if typed else "('var' / 'let') bind (',' bind)* / ('const' / 'await'? TYPE) set (',' set)*"}
body = ASI? (ifs / loop / id ':' body / @block / simple)
ifs = 'if' @args body (ASI? 'else' 'if' @args body)* (ASI? 'else' body)?
loop = ('for' 'await'? @forhead / 'while' @args / 'with' @args) body / 'do' body ASI? 'while' @args end?
whole = 'try' @block (ASI? 'catch' @params? @block)? (ASI? 'finally' @block)? / 'switch' @args @sblock / 'do' @block ASI? 'while' @args end?
jump = 'return' exprs? end / 'throw' exprs end / ('break' / 'continue') id? end / 'debugger' end
simple = ';' / ASI / var end / jump / whole / exprs end
spec = 'type'? (name / STR) ('as' (name / STR))?
clause = id (',' (@specs / '*' 'as' id))? / '*' 'as' id / @specs
import = 'import' ({"'type'? id '=' exprs / " if typed else ""}STR / 'type'? clause 'from' STR) ('with' @obj)? end
export = deco* 'export' ({"import / 'as' 'namespace' id end / " if typed else ""}'default' (fun / class {"/ face / 'async'? 'function' '*'? id? gen? @params annot? end" if typed else ""} / exprs end) / 'type'? '*' ('as' (name / STR))? 'from' STR ('with' @obj)? end / 'type'? @specs ('from' STR)? end / deco* decl {"/ '=' exprs end" if typed else ""})
{'''alias = 'type' id gen? '=' type end
face = 'interface' id gen? ('extends' type (',' type)*)? @tobj
space = ('namespace' / 'module') (id ('.' id)* / STR) @block / TYPE @block
enum = 'const'? 'enum' id @ebody
decl = fun / class / face / alias / space / enum / 'async'? 'function' '*'? id gen? @params annot? end / var end / 'declare' (fun / 'function' id gen? @params annot? end / class / face / alias / space / enum / var end / id @block)
''' if typed else "decl = fun / class / var end"}
stmt = @block / ifs / loop / whole / import / export / decl / id ':' body / simple
case = ('case' exprs / 'default') ':' / stmt
prop = name / STR / NUM / @idx
mod = ('static' / 'get' / 'set' / 'async' {"/ 'public' / 'private' / 'protected' / 'readonly' / 'abstract' / 'declare' / 'override'" if typed else ""} / TYPE) &(prop / '*')
member = ';' / ASI / 'static' @block / {"mod* @tkey annot end / " if typed else ""}deco* mod* '*'? prop opt? (gen? @params annot? (@block {"/ end" if typed else ""}) / annot? ('=' expr)? end)
pair = '...' expr / mod* '*'? prop gen? @params annot? @block / prop ':' expr / id ('=' expr)?
param = deco* {"('public' / 'private' / 'protected' / 'readonly' / 'override')*" if typed else ""} '...'? (id / 'this' / @obj / @arr) opt? annot? ('=' expr)?
params = (param (',' param)* ','?)?
args = ('...'? expr (',' '...'? expr)* ','?)?
forhead = ('var' / 'let' / 'const' / 'await'? TYPE)? operand1 ('of' / 'in') exprs / (var / exprs)? ';' exprs? ';' exprs?
operand1 = (id / @obj / @arr) post*
{'''tparen = type
ttuple = (telem (',' telem)* ','?)?
telem = '...'? (id '?'? ':')? type '?'?
tidx = type?
tmem = ('readonly' &(prop / @tkey) / '+' / '-')* ('new'? gen? @params annot? / @tkey ('+' / '-')? '?'? annot / mod* prop '?'? (gen? @params annot? / annot)?)
titem = ';' / ',' / ASI / tmem &(';' / ',' / ASI / END / @params)
tobj = titem*
tkey = id (':' type / 'in' type ('as' type)?)
ebody = ((name / STR) ('=' expr)? (',' (name / STR) ('=' expr)?)* ','?)?
''' if typed else ""}arr = ','* ('...'? expr (','+ '...'? expr)*)? ','*
idx = exprs
obj = (pair (',' pair)* ','?)?
cbody = member*
sblock = ASI? (&('case' / 'default') / END) case*
specs = (spec (',' spec)* ','?)?
file = stmt*
"""


def _script_grammar(typed: bool) -> Grammar:
    t = typed
    return Grammar(_script(typed), SCRIPT_LEXER.tokens, {
        "(": {r: r for r in ["params", "args", "forhead", *["tparen"] * t]},
        "[": {r: r for r in ["arr", "idx", *["ttuple", "tidx", "tkey"] * t]},
        "{": {"block": "file", **{r: r for r in ["obj", "cbody", "sblock", "specs", *["tobj", "ebody"] * t]}},
    }, "file", "; : ASI ,")


TYPESCRIPT = _script_grammar(True)
JAVASCRIPT = _script_grammar(False)

# ------------------------------------------------------------------ Rust

RUST_LEXER = Lexer(
    r"[ \t\r\f\v\n]++|//[^\n]*+|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*+\*/)*+\*/",
    [r"union\s+(?=[^\W\d]\w*+\s*+(?:[<{]|where\b))", r"r#[^\W\d]\w*", r'b?r"[^"]*+"', r'b?r#"[\s\S]*?"#', r'b?r##"[\s\S]*?"##', r'[bc]?"(?:[^"\\]|\\[\s\S])*+"', r"b?'(?:[^'\\\n]|\\[^\n][^'\n]*+)'", r"'[^\W\d]\w*"],
    "as async await break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return"
    " self Self static struct super trait type unsafe use where while",
    "+ - * / % ^ ! & | && || += -= *= /= %= ^= &= |= = == != > < >= <= @ . .. ... ..= , ; : :: -> => # $ ?",
    dotted=False,
)
_RUST = r"""
seg = ID / 'self' / 'Self' / 'super' / 'crate'
tp = '::'? seg ('::' seg)* ta? ('::' seg ta?)*
tv = tp (@types '->' / @types)? / @types / @tarr / '!'
tpre = '&&'? '&' LIFE? 'mut'? / '&&' LIFE? 'mut'? / '*' ('const' / 'mut') / 'dyn' / 'impl' / 'for' '<' LIFE (',' LIFE)* '>' / '?' / ('unsafe' / 'extern' STR?)* 'fn' @types '->' / tp @types '->'
tb = tpre* (('unsafe' / 'extern' STR?)* 'fn' @types / tp ('!' @mac / @types)? / @types / @tarr / '!' / '<' type ('as' tp)? '>' ('::' seg ta?)+)
ty = (LIFE / tb) ('+' (LIFE / tb / 'use' ta))*
ta = '::'? '<' (ga (',' ga)* ','?)? '>'
ga = ID '=' ty / ID ':' ty / ty / '-'? NUM / STR / @block
type = ty
bounds = (LIFE / '?'? type) ('+' (LIFE / '?'? type))* '+'?
path = ('<' type ('as' type)? '>' '::' / '::')? seg ('::' (seg / ta))*
mac = path '!' ID? (@mac)
pat0 = '&' 'mut'? / '&&' / 'ref' 'mut'? / 'mut' / ID '@'
lit = '-'? NUM / STR
pat1 = lit (('..=' / '...' / '..') (lit / path)?)? / ('..=' ) lit / '..' (lit / path)? / mac / path (@pats / @fpats / ('..=' / '..') (lit / path)?)? / @pats / 'const' @block
pat = '|'? pat0* pat1 ('|' pat0* pat1)*
cpat = pat0* pat1
lam = 'async'? 'move'? ('||' / '|' (cpat (':' type)? (',' cpat (':' type)?)* ','?)? '|') ('->' type &@block)?
un = '-' / '!' / '*' / '&' ID ('mut' / 'const') / '&&'? '&' 'mut'? / '&&' 'mut'? / '..=' / '..' &(NUM / STR / seg / @args / '&' / '*' / '-' / '::')
jump = 'return' / 'break' LIFE? / 'continue' LIFE?
start = NUM / STR / seg / @args / @arr / @block / 'if' / 'match' / '&' / '*' / '!' / '-' / '|' / '||' / 'move' / 'unsafe' / 'loop' / '::' / 'async'
pre = lam / un / jump &start
core0 = NUM / STR / mac / path / @args / @arr / jump / '..' / 'unsafe'? @block / 'match' expr0 @arms
post = '.' (ID ('::' ta)? / NUM / 'await') / '?' / @args / @idx
bin = '>' '>=' / '>' '>' / '<' '<=' / '<' '<' / '+' / '-' / '*' / '/' / '%' / '^' / '&' / '|' / '&&' / '||' / '+=' / '-=' / '*=' / '/=' / '%=' / '^=' / '&=' / '|=' / '=' / '==' / '!=' / '>' / '<' / '>=' / '<='
op0 = pre* core0 post*
tail0 = 'as' tb / ('..=' / '..') (!@block op0)? / bin op0
expr0 = op0 tail0*
cond1 = ('let' pat '=')? expr0
cond = cond1 ('&&' cond1)*
ifs = 'if' cond @block ('else' 'if' cond @block)* ('else' @block)?
blocky = (LIFE ':')? (ifs / 'match' expr0 @arms / 'loop' @block / 'while' cond @block / 'for' pat 'in' expr0 @block / 'unsafe' @block / 'async' 'move'? @block / 'const' @block / @block)
core = blocky / NUM / STR / mac / path @slit? / @args / @arr / jump / '..'
op = pre* core post*
tail = 'as' tb / ('..=' / '..') op? / bin op
expr = op tail*
attr = '#' '!'? @mac
vis = 'pub' @mac?
gparam = attr* (LIFE (':' LIFE ('+' LIFE)*)? / 'const' ID ':' type ('=' (lit / @block / ID))? / ID (':' bounds?)? ('=' type)?)
gps = '<' (gparam (',' gparam)* ','?)? '>'
wh = ('for' '<' LIFE (',' LIFE)* '>')? (LIFE / type) ':' bounds?
where = 'where' (wh (',' wh)*)? ','?
fn = ('const' / 'async' / 'unsafe' / 'extern' STR?)* 'fn' ID gps? @params ('->' type)? where? (@block / ';')
struct = ('struct' / TYPE) ID gps? (where? @fields / @tfields where? ';' / where? ';')
enum = 'enum' ID gps? where? @variants
impl = 'unsafe'? 'impl' gps? 'const'? '!'? type ('for' type)? where? @items
trait = 'unsafe'? 'trait' ID gps? (':' bounds?)? where? (@items / '=' bounds ';')
use1 = ('::')? (seg '::')* (seg ('as' ID)? / '*' / @uses)
item = attr* vis? (fn / struct / enum / impl / trait / 'mod' ID (@items / ';') / 'use' use1 ';' / ('const' / 'static' 'mut'?) ID ':' type ('=' expr)? ';' / 'type' ID gps? (':' bounds?)? where? ('=' type)? where? ';' / 'extern' 'crate' (ID / 'self') ('as' ID)? ';' / 'unsafe'? 'extern' STR? @items / ID '!' ID @mac ';'?)
let = 'let' pat (':' type)? ('=' expr ('else' @block)?)? ';'
stmt = ';' / attr* let / attr* blocky !('.' / '?' / 'as' ) / item / attr* (mac ';'? !('.' / '?') / expr ';') / attr* expr END
block = ('#' '!' @mac)* stmt*
arm = attr* pat ('if' ('let' pat '=')? expr)? '=>' (expr (',' / END) / blocky ','?)
args = (attr* expr (',' attr* expr)* ','?)?
types = (attr* ((ID ':')? type) (',' (attr* (ID ':')? ('...' / type)))* ','?)?
params = (attr* param (',' attr* param)* ','?)?
param = ('&' LIFE?)? 'mut'? 'self' (':' type)? / pat ':' type / '...' / type
tfields = (attr* vis? type (',' attr* vis? type)* ','?)?
pats = (pat (',' pat)* ','?)?
macro = (ANY / @mac)*
arr = (expr ';' expr / attr* expr (',' attr* expr)* ','?)?
tarr = type (';' expr)?
slitf = attr* (ID / NUM) (':' expr)?
slit = (slitf (',' slitf)* ','?)? ('..' expr)?
fields = (attr* vis? ID ':' type (',' attr* vis? ID ':' type)* ','?)?
variant = attr* vis? ID (@tfields / @fields)? ('=' expr)?
variants = (variant (',' variant)* ','?)?
uses = (use1 (',' use1)* ','?)?
iitem = item / attr* mac ';'?
items = iitem*
fpat = attr* ('..' / (ID / NUM) ':' pat / 'ref'? 'mut'? ID)
fpats = (fpat (',' fpat)* ','?)?
arms = ('#' '!' @mac)* arm*
top = item / attr* mac ';'? / ';'
file = ('#' '!' @mac)* top*
"""
RUST = Grammar(_RUST, RUST_LEXER.tokens, {
    "(": {"args": "args", "types": "types", "params": "params", "tfields": "tfields", "pats": "pats", "mac": "macro"},
    "[": {"arr": "arr", "idx": "expr", "tarr": "tarr", "pats": "pats", "mac": "macro"},
    "{": {"block": "block", "slit": "slit", "arms": "arms", "fields": "fields", "variants": "variants", "uses": "uses",
          "items": "items", "fpats": "fpats", "mac": "macro"},
}, "file", "; ,")

#: Lower-case extension -> (language, lexer, grammar).
BY_EXTENSION = {
    "go": ("go", GO_LEXER, GO),
    "java": ("java", JAVA_LEXER, JAVA),
    "py": ("python", PYTHON_LEXER, PYTHON),
    "pyi": ("python", PYTHON_LEXER, PYTHON),
    **{e: ("typescript", SCRIPT_LEXER, TYPESCRIPT) for e in ("ts", "mts", "cts")},
    **{e: ("javascript", SCRIPT_LEXER, JAVASCRIPT) for e in ("js", "mjs", "cjs")},
    "rs": ("rust", RUST_LEXER, RUST),
}


def _class(tokens: dict[str, str], names: str) -> str:
    return "[" + "".join(re.escape(tokens[n]) for n in names.split()) + "]"


_go = GO_LEXER.tokens
_GO_END = re.compile("(?<=" + _class(_go, "ID NUM STR TPL break continue fallthrough return ++ -- ) ] }") + ")" + _go["NL"])
_js = SCRIPT_LEXER.tokens
#: Words that go on with the statement of the line before, unless they are names there.
_JOINING = ("of", "as", "catch", "finally", "extends", "implements", "from", "satisfies", "is")
_JS_END = re.compile(
    "(?:(?<=" + _class(_js, f"ID NUM STR TPL > void ) ] }} this super ++ -- return break continue debugger {_SOFT}") + r")|(?<=" + re.escape(_js["."]) + _class(_js, _HARD) + "))" + _js["NL"]
    + "(?=" + _js["NL"] + "*(?:" + _class(_js, "ID TYPE NUM STR [ ! ~ ++ -- @ " + " ".join(
        w for w in f"{_SOFT} {_HARD}".split() if w not in ("in", "instanceof", *_JOINING)))
    + "|" + _class(_js, " ".join(_JOINING)) + _class(_js, "= . ( [ ; ++ -- :") + ")" + ")"
)


def separators(language: str, chars: str) -> tuple[str, str]:
    """(chars with the statement ends that the language infers from line ends, the newline character to drop)."""
    if language == "go":
        return _GO_END.sub(_go[";"], chars), _go["NL"]
    if language in ("typescript", "javascript"):
        return _JS_END.sub(_js["ASI"], chars), _js["NL"]
    return chars, ""
