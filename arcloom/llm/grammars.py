"""Grammars of the supported dialects, for the recogniser in ``gll``.

Operator precedence does not matter to a recogniser, so expressions are chains of operands. A rule
that needs to know whether ``return`` is legal is written once and made twice (``{F}``).
"""

from __future__ import annotations

from functools import cache

from arcloom.llm.gll import Grammar

JAVA = r"""
unit = [package] import* typedecl* ;
package = annotation* 'package' qname ';' ;
qname = IDENT ('.' IDENT)* ;
import = 'import' ['static'] IDENT ('.' IDENT)* ['.' '*'] ';' ;
typedecl = ';' | modifier* anytype ;
anytype = class | interface | enum | @17 record | annotype ;
modifier = annotation | 'public' | 'protected' | 'private' | 'static' | 'abstract' | 'final' | 'native' | 'synchronized'
  | 'transient' | 'volatile' | 'strictfp' | 'default' | @17 'sealed' | @17 'non' '-' 'sealed' ;
annotation = '@' qname ['(' [annpairs | annvalue] ')'] ;
annpairs = IDENT '=' annvalue (',' IDENT '=' annvalue)* ;
annvalue = ternary | annotation | '{' [annvalue (',' annvalue)*] [','] '}' ;
class = 'class' IDENT [typeparams] ['extends' type] ['implements' types] [@17 'permits' types] body ;
interface = 'interface' IDENT [typeparams] ['extends' types] [@17 'permits' types] body ;
enum = 'enum' IDENT ['implements' types] '{' [constant (',' constant)*] [','] [';' member*] '}' ;
constant = annotation* IDENT [args] [body] ;
record = 'record' IDENT [typeparams] '(' [params] ')' ['implements' types] body ;
annotype = '@' 'interface' IDENT body ;
body = '{' member* '}' ;
member = ';' | ['static'] block | modifier* memberdecl ;
memberdecl = anytype
  | [typeparams] (type | 'void') IDENT '(' [params] ')' dims ['throws' types] (block | ['default' annvalue] ';')
  | type declarator (',' declarator)* ';'
  | [typeparams] IDENT '(' [params] ')' ['throws' types] block
  | IDENT block ;
typeparams = '<' typeparam (',' typeparam)* '>' ;
typeparam = annotation* IDENT ['extends' type ('&' type)*] ;
types = type (',' type)* ;
prim = 'int' | 'long' | 'short' | 'byte' | 'char' | 'boolean' | 'float' | 'double' ;
type = annotation* (prim | classtype) dims ;
classtype = IDENT [typeargs] ('.' annotation* IDENT [typeargs])* ;
typeargs = '<' [typearg (',' typearg)*] '>' ;
typearg = type | annotation* '?' [('extends' | 'super') type] ;
dims = (annotation* '[' ']')* ;
params = param (',' param)* ;
param = modifier* type ['...'] ((IDENT dims) | [IDENT '.'] 'this') ;
block = '{' statement* '}' ;
statement = block | ';' | local ';' | modifier* (class | @17 (interface | enum | record)) | effect ';'
  | 'if' par statement ['else' statement] | 'while' par statement | 'do' statement 'while' par ';'
  | 'for' '(' ([init] ';' [expr] ';' [effect (',' effect)*] | modifier* type IDENT dims ':' expr) ')' statement
  | 'try' (block (catch+ [finally] | finally) | resources block catch* [finally])
  | 'switch' par switchbody | 'synchronized' par block | 'return' [expr] ';' | 'throw' expr ';'
  | 'break' [IDENT] ';' | 'continue' [IDENT] ';' | @17 'yield' expr ';' | 'assert' expr [':' expr] ';' | IDENT ':' statement ;
init = local | effect (',' effect)* ;
resources = '(' resource (';' resource)* [';'] ')' ;
resource = modifier* type IDENT '=' expr | @11 primary ;
catch = 'catch' '(' modifier* type ('|' type)* IDENT ')' block ;
finally = 'finally' block ;
par = '(' expr ')' ;
local = modifier* type declarator (',' declarator)* ;
declarator = IDENT dims ['=' varinit] ;
varinit = expr | arrayinit ;
arrayinit = '{' [varinit (',' varinit)*] [','] '}' ;
effect = ('++' | '--') unary | primary ('++' | '--') | primary assignop expr | effectcall ;
effectcall = atom suffix* callsuffix | 'new' newrest suffix* | IDENT args | ('this' | 'super') args ;
switchbody = '{' [switchlabel ':' (switchlabel ':' | statement)*] '}' | '{' (switchlabel @17 '->' (expr ';' | block | 'throw' expr ';'))+ '}' ;
switchlabel = 'case' caselabel (@17 ',' caselabel)* | 'default' ;
caselabel = ternary ;
assignop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '>>>=' ;
expr = lambda | ternary | primary assignop expr ;
lambda = (IDENT | '(' [IDENT (',' IDENT)* | params] ')') '->' (expr | block) ;
ternary = binary ['?' expr ':' (ternary | lambda)] ;
binary = unary (binop unary | 'instanceof' [@17 'final'] type [@17 IDENT])* ;
binop = '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' ['>'] | '+' | '-' | '*' | '/' | '%' ;
unary = ('+' | '-' | '!' | '~' | '++' | '--') unary | cast | postfix ;
cast = '(' annotation* prim dims ')' unary | '(' type ('&' type)* ')' (('!' | '~') unary | cast | postfix | lambda) ;
postfix = primary ('++' | '--')* ;
primary = atom suffix* ;
atom = LITERAL | @17 TEXTBLOCK | 'this' [args] | 'super' [args] | '(' expr ')' | 'new' newrest | IDENT [args] | @17 'switch' par switchbody
  | prim dims ('.' 'class' | '::' 'new') | 'void' '.' 'class' | IDENT ('.' IDENT)* typeargs ('.' IDENT [typeargs])* dims '::' ('new' | IDENT) ;
callsuffix = '.' [typeargs] IDENT args | '.' 'super' args | '.' 'new' newrest ;
suffix = '.' IDENT | callsuffix | '.' 'this' | '.' 'class' | '.' 'super' | '[' expr ']'
  | '[' ']' ('[' ']')* ('.' 'class' | '::' 'new') | '::' [typeargs] (IDENT | 'new') ;
newrest = annotation* [typeargs] (classtype args [body] | (prim | classtype) (annotation* '[' expr ']' (annotation* '[' expr ']')* dims | '[' ']' dims arrayinit)) ;
args = '(' [expr (',' expr)*] ')' ;
"""

_JS_STATEMENTS = r"""
block{F} = '{' item{F}* '}' ;
item{F} = statement{F} | function | class | lexical eos ;
statement{F} = block{F} | 'var' vars eos | ';' | simple eos | 'if' '(' expr ')' statement{F} ['else' statement{F}]
  | 'do' statement{F} 'while' '(' expr ')' [eos] | 'while' '(' expr ')' statement{F}
  | 'for' [@18 'await'] '(' forhead ')' statement{F} | 'continue' [IDENT] eos | 'break' [IDENT] eos | @sloppy 'with' '(' expr ')' statement{F}
  | 'switch' '(' expr ')' '{' (('case' expr | 'default') ':' item{F}*)* '}' | IDENT ':' (statement{F} | function) | 'throw' expr eos
  | 'try' block{F} ('catch' ('(' binding ')' block{F} | @20 block{F}) ['finally' block{F}] | 'finally' block{F}) | 'debugger' eos {RETURN} ;
"""

JS = (
    r"""
script = item* ;
eos = ';' | ASI ;
simple !'{' !'function' !'class' = expr ;
lexical = ('let' | 'const') vars ;
vars = var (',' var)* ;
var = binding ['=' assign] ;
forhead = [('var' | 'let' | 'const') vars | expr] ';' [expr] ';' [expr] | (('var' | 'let' | 'const') binding | lhs) ('in' expr | 'of' assign) ;
binding = IDENT | '[' bindelems ']' | '{' [bindprop (',' bindprop)*] [','] '}' ;
bindelems = [bindelem] (',' [bindelem])* ;
bindelem = ['...'] binding ['=' assign] ;
bindprop = IDENT ['=' assign] | propname ':' binding ['=' assign] | @18 '...' IDENT ;
function = ['async'] 'function' ['*'] [IDENT] '(' params ')' blockF ;
params = [param (',' param)* [',']] ;
param = ['...'] binding ['=' assign] ;
class = 'class' [IDENT] ['extends' lhs] '{' (';' | ['static'] method | ['static'] propname @22 field | @22 'static' blockF)* '}' ;
field = '=' assign eos | eos ;
method = ['async'] ['*'] propname '(' params ')' blockF | ('get' | 'set') propname '(' params ')' blockF ;
propname = name | STRING | NUMBER | @22 PRIVATE | '[' assign ']' ;
name = IDENT | KEYWORD ;
expr = assign (',' assign)* ;
assign = arrow | 'yield' [['*'] assign] | cond | lhs assignop assign ;
assignop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>>=' | '>>>=' | '&=' | '|=' | '^=' | @22 '&&=' | @22 '||=' | @22 '??=' ;
arrow = ['async'] (IDENT | '(' params ')') '=>' (blockF | concise) ;
concise !'{' = assign ;
cond = binary ['?' assign ':' assign] ;
binary = unary (binop unary)* ;
binop = @20 '??' | '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '===' | '!==' | '<' | '>' | '<=' | '>=' | 'instanceof' | 'in' | '<<' | '>>' | '>>>' | '+' | '-' | '*' | '/' | '%' | '**' ;
unary = ('delete' | 'void' | 'typeof' | '+' | '-' | '~' | '!' | '++' | '--' | 'PRE' | 'await') unary | @22 PRIVATE 'in' unary | lhs ['++' | '--'] ;
lhs = 'new'* atom suffix* ;
suffix = '.' (name | @22 PRIVATE) | @20 '?.' (name | @22 PRIVATE | args | '[' expr ']' | template) | '[' expr ']' | args | template ;
args = '(' [('...')? assign (',' ('...')? assign)* [',']] ')' ;
atom = 'this' | 'super' | IDENT | STRING | NUMBER | REGEX | 'null' | 'true' | 'false' | array | object | function | class | template
  | '(' expr ')' | 'new' '.' IDENT | @20 'import' ('(' assign [','] ')' | '.' IDENT) ;
template = TEMPLATE | THEAD expr (TMIDDLE expr)* TTAIL ;
array = '[' [arrelem] (',' [arrelem])* ']' ;
arrelem = ['...'] assign ;
object = '{' [prop (',' prop)* [',']] '}' ;
prop = propname ':' assign | IDENT ['=' assign] | @18 '...' assign | method ;
"""
    + _JS_STATEMENTS.replace("{F}", "").replace("{RETURN}", "")
    + _JS_STATEMENTS.replace("{F}", "F").replace("{RETURN}", "| 'return' [expr] eos")
)

PYTHON = r"""
module = (NEWLINE | statement)* ;
statement = simples | compound ;
simples = simple (';' simple)* [';'] NEWLINE ;
simple = assignment | 'del' targets | 'pass' | 'break' | 'continue' | 'return' [stars] | 'raise' [expr ['from' expr]]
  | 'global' NAME (',' NAME)* | 'nonlocal' NAME (',' NAME)* | 'assert' expr [',' expr]
  | 'import' dotted ['as' NAME] (',' dotted ['as' NAME])*
  | 'from' (('.' | '...')* dotted | ('.' | '...')+) 'import' ('*' | froms | '(' froms [','] ')')
  | @12 'type' NAME [typeparams] '=' expr ;
froms = NAME ['as' NAME] (',' NAME ['as' NAME])* ;
dotted = NAME ('.' NAME)* ;
assignment = stars | (stars '=')+ (yield | stars) | primary augop (yield | stars) | primary ':' expr ['=' (yield | stars)] | yield ;
augop = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**=' ;
yield = 'yield' ['from' expr | stars] ;
compound = 'if' named ':' suite ('elif' named ':' suite)* ['else' ':' suite] | 'while' named ':' suite ['else' ':' suite]
  | ['async'] 'for' targets 'in' stars ':' suite ['else' ':' suite]
  | 'try' ':' suite (except+ ['else' ':' suite] ['finally' ':' suite] | 'finally' ':' suite)
  | ['async'] 'with' (withitems | @10 '(' withitems [','] ')') ':' suite
  | ('@' named NEWLINE)* (['async'] 'def' NAME [typeparams] '(' params ')' ['->' expr] ':' suite | 'class' NAME [typeparams] ['(' arglist ')'] ':' suite)
  | @10 'match' stars ':' NEWLINE INDENT ('case' patterns ['if' named] ':' suite)+ DEDENT ;
except = 'except' [@12 '*'] [expr (',' expr)* ['as' NAME]] ':' suite ;
withitems = withitem (',' withitem)* ;
withitem = expr ['as' target] ;
suite = simples | NEWLINE INDENT statement+ DEDENT ;
typeparams = @12 '[' typeparam (',' typeparam)* [','] ']' ;
typeparam = ['*' | '**'] NAME [':' expr] ['=' expr] ;
params = [param (',' param)* [',']] ;
param = NAME [':' expr] ['=' expr] | '*' [NAME [':' [@12 '*'] expr]] | '**' NAME [':' expr] | @8 '/' ;
lparams = [lparam (',' lparam)* [',']] ;
lparam = NAME ['=' expr] | '*' [NAME] | '**' NAME | @8 '/' ;
stars = star (',' star)* [','] ;
star = '*' chain | named ;
named = NAME @8 ':=' expr | expr ;
expr = chain ['if' chain 'else' expr] | 'lambda' lparams ':' expr ;
chain = unary (binop unary)* ;
binop = 'and' | 'or' | '<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' ['not'] | '|' | '^' | '&' | '<<' | '>>' | '+' | '-' | '*' | '@' | '/' | '%' | '//' | '**' ;
unary = ('not' | '+' | '-' | '~') unary | ['await'] primary ;
primary = atom trailer* ;
trailer = '.' NAME | '(' arglist ')' | '[' subscript (',' subscript)* [','] ']' ;
subscript = star | [expr] ':' [expr] [':' [expr]] ;
arglist = [arg (',' arg)* [',']] ;
arg = named [comp] | NAME '=' expr | '*' expr | '**' expr ;
atom = NAME | NUMBER | STRING+ | '...' | 'None' | 'True' | 'False' | '(' [yield | named comp | stars] ')' | '[' [named comp | stars] ']' | '{' [dictset] '}' ;
dictset = pair (',' pair)* [','] | expr ':' expr comp | star (',' star)* [','] | named comp ;
pair = expr ':' expr | '**' chain ;
comp = (['async'] 'for' targets 'in' chain ('if' (NAME @8 ':=' chain | chain | 'lambda' lparams ':' expr))*)+ ;
targets = target (',' target)* [','] ;
target = ['*'] primary ;
patterns = pattern (',' pattern)* [','] ;
pattern = (alternatives ['as' NAME] | '*' NAME) ;
alternatives = closed ('|' closed)* ;
closed = ['-'] NUMBER [('+' | '-') NUMBER] | STRING+ | 'None' | 'True' | 'False' | dotted ['(' [patarg (',' patarg)* [',']] ')']
  | '(' [patterns] ')' | '[' [patterns] ']' | '{' [patpair (',' patpair)* [',']] '}' ;
patarg = [NAME '='] pattern ;
patpair = (['-'] NUMBER | STRING+ | 'None' | 'True' | 'False' | NAME ('.' NAME)+) ':' pattern | '**' NAME ;
"""

JSON = r"""
text = value ;
value = STRING | NUMBER | 'true' | 'false' | 'null' | '[' [value (',' value)*] ']' | '{' [STRING ':' value (',' STRING ':' value)*] '}' ;
"""

XML = r"""
document = [DECL] MISC* [DOCTYPE MISC*] element MISC* ;
element = EMPTY | OPEN (element | TEXT | MISC)* CLOSE ;
"""


#: The dialects that run together, and the gates to what they do not share.
JAVA_DIALECTS = ("Java 8", "Java 11", "Java 17")
JS_DIALECTS = ("ES2017", "ES2018", "ES2020", "ES2022", "ES2022 strict")
PYTHON_DIALECTS = ("3.7", "3.8", "3.10", "3.12")
_GATES = {
    "java": {g: JAVA_DIALECTS[k:] for k, g in ((1, "11"), (2, "17"))},
    "js": {g: JS_DIALECTS[k:] for k, g in ((1, "18"), (2, "20"), (3, "22"))} | {"sloppy": JS_DIALECTS[:4]},
    "py": {g: PYTHON_DIALECTS[k:] for k, g in ((1, "8"), (2, "10"), (3, "12"))},
}


@cache
def grammar(language: str) -> Grammar:
    """Compiled once a worker."""
    return {
        "java": lambda: Grammar(JAVA, ("unit",), (), JAVA_DIALECTS, _GATES["java"]),
        "js": lambda: Grammar(JS, ("script",), ("ASI",), JS_DIALECTS, _GATES["js"]),
        "py": lambda: Grammar(PYTHON, ("module",), (), PYTHON_DIALECTS, _GATES["py"]),
        "json": lambda: Grammar(JSON, ("text",), (), ("RFC 8259",)),
        "xml": lambda: Grammar(XML, ("document",), (), ("XML 1.0",)),
    }[language]()
