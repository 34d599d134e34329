"""Token patterns and grammars of the source languages, for syntax only: names, types and includes don't matter.

The grammars describe a superset of each language where only meaning decides (a type or a value, say), so that what they
reject is wrong under any reading.
"""

from __future__ import annotations

C_COMMON = """
decl = spec { ditem } [ ':' cond ] [ dinit ] { ',' { ditem } [ ':' cond ] [ dinit ] } ';' ;
ditem = spec | ptr | attr | '(' [ params ] ')' | '[' [ expr ] ']' ;
attr = ATTR [ '(' bal ')' ] ;
bal = { ANYTOK | '(' bal ')' | '[' bal ']' | '{' bal '}' } ;
params = param { ',' param } ;
param = '...' | spec { ditem | '...' } [ '=' init ] | arg ;
block = '{' { stmt } '}' ;
stmt = block | ifs | 'while' '(' head ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | 'for' '(' forhead ')' stmt
  | 'switch' '(' head ')' stmt | 'case' cond [ '...' cond ] ':' | 'default' ':' | ID ':' | 'goto' ( ID | '*' unary ) ';'
  | 'break' ';' | 'continue' ';' | 'return' [ retval ] ';' | ';' | decl | expr ';' | ID '(' [ args ] ')' ( block | stmtonly )
  | 'asm' { T | 'goto' } '(' asmbody ')' ';' | tagdef | more ;
stmtonly = ifs | 'for' '(' forhead ')' stmt | 'while' '(' head ')' stmt | 'return' [ retval ] ';' | 'break' ';' | 'continue' ';' | 'goto' ID ';' ;
asmbody = { STR | ID | NUM | ':' | ',' | '[' bal ']' | '(' bal ')' | '::' } ;
ifs = 'if' { T } '(' head ')' stmt [ 'else' stmt ] ;
expr = assign { ',' assign } ;
assign = unary { BIN unary | '*' unary | '&' unary | '&&' unary | '-' unary | '+' unary | '<' unary | '>' unary | '>' '>' unary | '=' init | '?' [ expr ] ':' unary } ;
cond = assign ;
init = assign | '{' [ inits ] '}' ;
inits = initem { ',' initem } [ ',' ] ;
initem = desig { desig } [ '=' ] init | ID ':' init | init | '...' ;
desig = '.' ID | '[' cond [ '...' cond ] ']' ;
prefix = '+' | '-' | '*' | '&' | '&&' | '!' | '~' | '++' | '--' | 'sizeof' | EXT ;
arg = init | typename ;
args = arg { ',' arg } [ ',' ] ;
typename = spec { spec | ptr | attr | '(' [ params ] ')' | '[' [ expr ] ']' } ;
enumbody = '{' [ enumr { ',' enumr } [ ',' ] ] '}' ;
enumr = ID { attr } [ '=' cond ] ;
"""

C = (
    """
tu = { ext } ;
ext = ';' | decl | func | tagdef | 'asm' '(' asmbody ')' ';' ;
func = spec { ditem } '(' [ params ] ')' { T | attr | ID } { spec { ditem } { ',' { ditem } } ';' } block [ ';' ] ;
tagdef = NEVER ;
more = NEVER ;
spec = T | ID | tag | attr ;
dinit = '=' init ;
ptr = '*' ;
tag = ( 'struct' | 'union' ) { attr } [ ID ] { attr } [ '{' { member } '}' ] | 'enum' { attr } [ ID ] [ ':' T { T } ] [ enumbody ] ;
member = decl | ';' ;
head = expr ;
retval = expr ;
forhead = ( decl | [ expr ] ';' ) [ expr ] ';' [ expr ] ;
unary = { prefix } atom { post } ;
atom = ID | NUM | CHR | str | paren [ castarg ] ;
str = STR { STR | ID } ;
paren = '(' ( expr | typename | block ) ')' ;
castarg = { '!' | '~' | 'sizeof' } ( ID | NUM | CHR | str ) | '{' [ inits ] '}' | ( '++' | '--' ) ID ;
post = '(' [ args ] ')' | '[' expr ']' | '.' ID | '->' ID | '++' | '--' ;
"""
    + C_COMMON
)

CPP = (
    """
tu = { ext } ;
ext = ';' | decl | func | tagdef | 'asm' '(' asmbody ')' ';' | 'namespace' { attr } [ qid ] '{' { ext } '}' | T 'namespace' ID '{' { ext } '}'
  | 'namespace' ID '=' qid ';' | using | 'extern' STR ( '{' { ext } '}' | ext ) | 'extern' 'template' decl | template ext | 'concept' ID '=' expr ';' ;
template = 'template' [ '<' [ tparam { ',' tparam } ] '>' ] [ 'requires' unary { '&&' unary | BIN unary } ] ;
tparam = [ template ] ( 'class' | spec ) { spec | ptr | '...' } [ '=' targ ] ;
using = 'using' [ 'namespace' | 'typename' | 'enum' ] qid [ '=' typename ] { ',' qid } ';' | 'using' ID { attr } '=' typename ';' ;
func = ( spec | 'extern' ) { ditem } '(' [ params ] ')' fquals [ ':' meminit { ',' meminit } ] ( block | 'try' block catch { catch } ) [ ';' ]
  | ( spec | 'extern' ) { ditem } '(' [ params ] ')' fquals '=' ( 'default' | 'delete' | NUM ) ';' | ( spec | 'extern' ) { ditem } '(' [ params ] ')' fquals ';' ;
fquals = { T | attr | ID | '&' | '&&' } [ '->' typename ] [ 'requires' unary ] ;
meminit = qid ( '(' [ args ] ')' | '{' [ inits ] '}' ) [ '...' ] ;
tagdef = NEVER ;
more = 'try' block catch { catch } | using | template decl | 'namespace' ID '=' qid ';' ;
catch = 'catch' '(' ( '...' | spec { ditem } ) ')' block ;
dinit = '=' init | '{' [ inits ] '}' ;
spec = T | qid | tag | attr | '[' '[' bal ']' ']' | 'decltype' '(' expr ')' | 'typename' qid | '~' ID | 'extern' ;
qid = [ '::' ] qpart { '::' [ 'template' ] ( qpart | '~' ID ) | '::' '*' } ;
qpart = ID [ '<' [ targ { ',' targ } ] '>' ] | 'operator' oper ;
oper = BIN | '*' | '&' | '&&' | '-' | '+' | '<' | '>' | '=' | '!' | '~' | '++' | '--' | '->' | ',' | '(' ')' | '[' ']' | 'new' [ '[' ']' ] | 'delete' [ '[' ']' ] | STR ID | T { T | ptr } | ID { ptr } | '>' '>' ;
targ = [ '...' ] ( tassign | typename ) [ '...' ] ;
tassign = unary { BIN unary | '*' unary | '&' unary | '&&' unary | '-' unary | '+' unary | '<' unary | '?' tassign ':' unary } ;
ptr = '*' | '&' | '&&' | '...' ;
tag = ( 'struct' | 'union' | 'class' ) { attr } [ qid ] [ ID ] [ ':' base { ',' base } ] [ '{' { member } '}' ] | 'enum' [ 'class' | 'struct' ] { attr } [ qid ] [ ':' typename ] [ enumbody ] ;
base = { T | ACCESS } qid [ '...' ] ;
member = ext | ACCESS ':' ;
head = [ decl | expr ';' | ';' ] ( expr | spec { ditem } ( '=' init | '{' [ inits ] '}' ) ) ;
retval = expr | '{' [ inits ] '}' ;
forhead = ( decl | [ expr ] ';' ) [ expr ] ';' [ expr ] | [ decl ] spec { ditem } ':' init ;
unary = { prefix | 'delete' [ '[' ']' ] | 'throw' } atom { post } | 'throw' | 'new' [ '(' args ')' ] newtype { post } | ( '+' | '-' | '*' | '&' | '!' ) 'new' newtype ;
newtype = ( spec { spec | '*' } | '(' typename ')' ) { '[' expr ']' } [ '(' [ args ] ')' | '{' [ inits ] '}' ] ;
atom = qid | NUM | CHR | str | paren [ castarg ] | lambda | T { T } ( '(' [ args ] ')' | '{' [ inits ] '}' ) | 'decltype' '(' expr ')' | 'typename' qid ( '(' [ args ] ')' | '{' [ inits ] '}' ) ;
lambda = '[' [ capture { ',' capture } ] ']' [ '<' [ tparam { ',' tparam } ] '>' ] [ '(' [ params ] ')' ] { T | attr } [ '->' typename ] block ;
capture = [ '&' | '=' | '*' | '...' ] [ ID [ '...' ] [ '=' init | '{' [ inits ] '}' ] ] ;
str = STR { STR | ID } ;
paren = '(' ( expr | typename | '...' fold expr | expr fold '...' [ fold expr ] | block ) ')' ;
fold = BIN | ',' | '+' | '-' | '*' | '&' | '&&' | '<' | '>' | '=' ;
castarg = { '!' | '~' | 'sizeof' } ( qid | NUM | CHR | str ) | '{' [ inits ] '}' | ( '++' | '--' ) ID ;
post = '(' [ args ] ')' | '[' [ expr ] ']' | ( '.' | '->' ) [ 'template' ] ( qid | '~' ID | '*' atom ) | '++' | '--' | '{' [ inits ] '}' | '...' ;
"""
    + C_COMMON
)

JS = """
tu = { stmt } ;
block = '{' { stmt } '}' ;
stmt = block | ';' | vars ';' | named_func | 'async' named_func | class | 'if' '(' expr ')' stmt [ 'else' stmt ] | 'for' [ 'await' ] '(' forhead ')' stmt
  | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' [ ';' ] | 'switch' '(' expr ')' '{' { ( 'case' expr | 'default' ) ':' { stmt } } '}'
  | 'try' block ( 'catch' [ '(' bind ')' ] block [ 'finally' block ] | 'finally' block ) | 'throw' expr ';' | 'return' [ expr ] ';'
  | ( 'break' | 'continue' ) [ ID ] ';' | 'debugger' ';' | import | export | ID ':' stmt | 'with' '(' expr ')' stmt | sassign { ',' assign } ';' ;
vars = ( 'var' | 'let' | 'const' ) bind [ '=' assign ] { ',' bind [ '=' assign ] } ;
bind = ID | soft | array | object ;
soft = 'async' | 'of' | 'let' | 'static' | 'as' | 'from' ;
forhead = [ vars | expr ] ';' [ expr ] ';' [ expr ] | ( ( 'var' | 'let' | 'const' ) bind | unary ) ( 'of' | 'in' ) expr ;
func = 'function' [ '*' ] [ ID | soft ] '(' [ params ] ')' block ;
named_func = 'function' [ '*' ] ( ID | soft ) '(' [ params ] ')' block ;
params = param { ',' param } [ ',' ] ;
param = [ '...' ] bind [ '=' assign ] ;
class = { '@' unary } 'class' [ ID ] [ 'extends' unary ] '{' { member } '}' ;
member = ';' | 'static' block | { 'static' | 'async' | ID } [ '*' ] pname ( '(' [ params ] ')' block | [ '=' assign ] ';' ) ;
pname = name | STR | NUM | '[' assign ']' | PRIVATE ;
name = ID | soft | 'var' | 'const' | 'if' | 'else' | 'for' | 'while' | 'do' | 'switch' | 'case' | 'default' | 'break' | 'continue' | 'return' | 'function' | 'class' | 'extends' | 'new' | 'delete' | 'typeof' | 'void' | 'in' | 'import' | 'export' | 'try' | 'catch' | 'finally' | 'throw' | 'yield' | 'await' | 'debugger' | 'with' | BIN ;
import = 'import' ( STR | ( ID | soft ) [ ',' ( named | star ) ] 'from' STR | ( named | star ) 'from' STR ) [ ( 'with' | ID ) object ] ';' ;
star = '*' 'as' ID ;
named = '{' [ pick { ',' pick } [ ',' ] ] '}' ;
pick = ( name | STR ) [ 'as' ( name | STR ) ] ;
export = 'export' ( vars ';' | func | 'async' func | class | 'default' ( func | 'async' func | class | assign ';' ) | named [ 'from' STR ] ';' | '*' [ 'as' name ] 'from' STR ';' ) ;
expr = assign { ',' assign } ;
assign = unary tail ;
sassign = sunary tail ;
tail = { BIN unary | '*' unary | '-' unary | '+' unary | '/' unary | '=' assign | 'in' unary | '=>' ( block | assign ) | '?' assign ':' assign } ;
unary = { prefix } ( atom { post } | 'yield' ) ;
sunary = prefix { prefix } ( atom { post } | 'yield' ) | satom { post } | 'yield' ;
prefix = '+' | '-' | '!' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' | 'new' | 'yield' [ '*' ] ;
satom = ID | soft | NUM | STR | TPL | REGEX | '(' [ list ] ')' | array | 'import' | PRIVATE ;
atom = satom | object | func | 'async' func | class ;
list = item { ',' item } [ ',' ] ;
item = [ '...' ] assign ;
array = '[' { ',' } [ item { ',' { ',' } item } { ',' } ] ']' ;
object = '{' [ prop { ',' prop } [ ',' ] ] '}' ;
prop = '...' assign | pname [ ':' assign | '=' assign ] | { ID | 'async' | 'static' } [ '*' ] pname '(' [ params ] ')' block ;
post = '(' [ list ] ')' | '[' expr ']' | '.' ( name | PRIVATE ) | '?.' ( name | '[' expr ']' | '(' [ list ] ')' | PRIVATE ) | '++' | '--' | TPL ;
"""

GO = """
tu = 'package' ID ';' { 'import' ( imp | '(' [ imp { ';' imp } [ ';' ] ] ')' ) ';' } { top ';' } [ top ] ;
imp = [ ID | '.' ] STR ;
top = func | decl ;
decl = 'const' ( cspec | '(' [ cspec { ';' cspec } [ ';' ] ] ')' ) | 'var' ( vspec | '(' [ vspec { ';' vspec } [ ';' ] ] ')' ) | 'type' ( tspec | '(' [ tspec { ';' tspec } [ ';' ] ] ')' ) ;
cspec = ids [ [ type ] '=' exprs ] ;
vspec = ids ( type [ '=' exprs ] | '=' exprs ) ;
tspec = ID [ '[' tparam { ',' tparam } [ ',' ] ']' ] [ '=' ] type ;
tparam = ids constraint ;
constraint = [ '~' ] type { '|' [ '~' ] type } ;
ids = ID { ',' ID } ;
func = 'func' [ params ] ID [ '[' tparam { ',' tparam } [ ',' ] ']' ] params [ result ] [ block ] ;
params = '(' [ param { ',' param } [ ',' ] ] ')' ;
param = [ ID ] [ '...' ] type ;
result = params | type ;
type = ID [ '.' ID ] [ '[' type { ',' type } ']' ] | '*' type | '[' ']' type | '[' ( expr | '...' ) ']' type | 'map' '[' type ']' type | 'chan' [ '<-' ] type | '<-' 'chan' type
  | 'func' params [ result ] | 'struct' '{' [ field { ';' field } [ ';' ] ] '}' | 'interface' '{' [ meth { ';' meth } [ ';' ] ] '}' | '(' type ')' ;
field = ( ids type | [ '*' ] ID [ '.' ID ] [ '[' type { ',' type } ']' ] ) [ STR ] ;
meth = ID params [ result ] | constraint ;
block = '{' { stmt ';' } [ stmt ] '}' ;
stmt = block | decl | ID ':' [ stmt ] | 'if' if | 'for' [ forhead ] block | 'switch' [ swhead ] '{' { case } '}' | 'select' '{' { comm } '}' | 'go' expr | 'defer' expr | 'return' [ exprs ]
  | ( 'break' | 'continue' | 'goto' ) [ ID ] | 'fallthrough' | simple ;
simple = exprs [ ':=' exprs | '=' exprs | ASG expr | '++' | '--' | '<-' expr ] ;
nsimple = nexprs [ ':=' nexprs | '=' nexprs | ASG nexpr | '++' | '--' | '<-' nexpr ] ;
if = [ [ nsimple ] ';' ] nexpr block [ 'else' ( 'if' if | block ) ] ;
forhead = nexpr | [ nsimple ] ';' [ nexpr ] ';' [ nsimple ] | [ nexprs ( ':=' | '=' ) ] 'range' nexpr ;
swhead = [ nsimple ] ';' [ nsimple ] | nsimple ;
case = ( 'case' types | 'default' ) ':' { stmt ';' } [ stmt ] ;
types = tyex { ',' tyex } ;
tyex = expr | type ;
comm = ( 'case' simple | 'default' ) ':' { stmt ';' } [ stmt ] ;
exprs = expr { ',' expr } ;
nexprs = nexpr { ',' nexpr } ;
expr = unary { op unary } ;
nexpr = nunary { op nunary } ;
op = BIN | '*' | '&' | '-' | '+' | '^' | '|' ;
unary = { pre } atom { post | body } ;
nunary = { pre } natom { post } ;
pre = '-' | '+' | '!' | '^' | '*' | '&' | '<-' | '~' ;
natom = ID | NUM | STR | CHR | '(' ( expr | type ) ')' | 'func' params [ result ] block | conv ;
conv = ( '[' ']' type | '[' ( expr | '...' ) ']' type | 'map' '[' type ']' type | 'chan' type | 'interface' '{' '}' | 'struct' '{' [ field { ';' field } [ ';' ] ] '}' ) ( body | '(' [ args ] ')' ) ;
atom = natom ;
post = '.' ( ID | '(' ( type | 'type' ) ')' ) | '[' index ']' | '(' [ args ] ')' ;
index = expr | type { ',' type } | [ expr ] ':' [ expr ] [ ':' expr ] ;
args = arg { ',' arg } [ ',' ] ;
arg = expr [ '...' ] | type ;
body = '{' [ elem { ',' elem } [ ',' ] ] '}' ;
elem = ( expr | body ) [ ':' ( expr | body ) ] ;
"""

PYTHON = """
tu = { NEWLINE | stmt } ;
stmt = simple | compound ;
simple = small { ';' small } [ ';' ] NEWLINE ;
small = assign | 'pass' | 'break' | 'continue' | 'return' [ tests ] | 'raise' [ test [ 'from' test ] ] | 'global' names | 'nonlocal' names | 'del' tests
  | 'assert' test [ ',' test ] | 'import' dotted [ 'as' name ] { ',' dotted [ 'as' name ] } | from | 'type' name [ tparams ] '=' test ;
from = 'from' { '.' | '...' } [ dotted ] 'import' ( '*' | '(' picks [ ',' ] ')' | picks ) ;
picks = name [ 'as' name ] { ',' name [ 'as' name ] } ;
dotted = name { '.' name } ;
names = name { ',' name } ;
name = ID | 'match' | 'case' | 'type' ;
assign = tests ( { '=' rhs } | AUG rhs | ':' test [ '=' rhs ] ) ;
rhs = tests | 'yield' [ 'from' test | tests ] ;
tests = item { ',' item } [ ',' ] | 'yield' [ 'from' test | tests ] ;
item = test | '*' test ;
suite = simple | NEWLINE INDENT stmt { stmt } DEDENT ;
compound = 'if' test ':' suite { 'elif' test ':' suite } [ 'else' ':' suite ] | 'while' test ':' suite [ 'else' ':' suite ] | [ 'async' ] 'for' targets 'in' tests ':' suite [ 'else' ':' suite ]
  | 'try' ':' suite ( 'except' [ '*' ] [ test { ',' test } [ 'as' name ] ] ':' suite { 'except' [ '*' ] [ test { ',' test } [ 'as' name ] ] ':' suite } [ 'else' ':' suite ] [ 'finally' ':' suite ] | 'finally' ':' suite )
  | [ 'async' ] 'with' withs ':' suite | { '@' test NEWLINE } ( [ 'async' ] 'def' name [ tparams ] '(' [ params ] ')' [ '->' test ] ':' suite | 'class' name [ tparams ] [ '(' [ args ] ')' ] ':' suite )
  | 'match' tests ':' NEWLINE INDENT casec { casec } DEDENT ;
casec = 'case' pats [ 'if' test ] ':' suite ;
pats = pat { ',' pat } [ ',' ] ;
pat = [ '*' ] test [ 'as' name ] ;
withs = withi { ',' withi } | '(' withi { ',' withi } [ ',' ] ')' ;
withi = test [ 'as' [ '*' ] atomx { ',' atomx } ] ;
targets = [ '*' ] atomx { ',' [ '*' ] atomx } [ ',' ] ;
tparams = '[' [ '*' | '**' ] name [ ':' test ] [ '=' test ] { ',' [ '*' | '**' ] name [ ':' test ] [ '=' test ] } [ ',' ] ']' ;
params = param { ',' param } [ ',' ] ;
param = '/' | '*' | [ '*' | '**' ] name [ ':' [ '*' ] test ] [ '=' test ] ;
lparams = lparam { ',' lparam } [ ',' ] ;
lparam = '/' | '*' | [ '*' | '**' ] name [ '=' test ] ;
test = 'lambda' [ lparams ] ':' test | or [ 'if' or 'else' test ] | name ':=' test ;
or = not { bin not } ;
bin = BIN | '*' | '**' | '-' | '+' | '@' | 'in' | 'not' 'in' | 'is' [ 'not' ] | 'and' | 'or' ;
not = { 'not' | '-' | '+' | '~' | 'await' } atomx ;
atomx = atom { '(' [ args ] ')' | '[' subs ']' | '.' name } ;
atom = name | NUM | STR { STR } | '...' | CONST | '(' [ group ] ')' | '[' [ group ] ']' | '{' [ braces ] '}' ;
group = item { ',' item } [ ',' ] | item comp | 'yield' [ 'from' test | tests ] ;
comp = [ 'async' ] 'for' targets 'in' or { [ 'async' ] 'for' targets 'in' or | 'if' or2 } ;
or2 = 'lambda' [ lparams ] ':' test | or | name ':=' or ;
braces = item { ',' item } [ ',' ] | item comp | kv { ',' kv } [ ',' ] | test ':' test comp ;
kv = test ':' test | '**' test ;
args = arg { ',' arg } [ ',' ] ;
arg = test [ comp ] | name '=' test | '*' test | '**' test ;
subs = sub { ',' sub } [ ',' ] ;
sub = [ '*' ] test | [ test ] ':' [ test ] [ ':' [ test ] ] ;
"""
