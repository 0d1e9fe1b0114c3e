"""Grammars of the five languages, in the EBNF of ``gll``, written from the languages' standards.

NAME, NUM, STR and so on are classes of tokens; rules are in lower case.  They are recognisers: operators of
all ranks form one list, as rank does not decide whether a text is valid.  Lists may be left recursive, as the
standards write them, or repetitions.
"""

from __future__ import annotations

#: Words and signs of each language.
C_WORDS = "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Alignas _Alignof _Atomic _Bool _Complex _Generic _Imaginary _Noreturn _Static_assert _Thread_local"
C_SIGNS = "... <<= >>= -> ++ -- << >> <= >= == != && || += -= *= /= %= &= ^= |= . & * + - ~ ! / % < > ^ | ? : = , ;"

CPP_WORDS = "alignas alignof asm auto bool break case catch char char8_t char16_t char32_t class concept const consteval constexpr constinit const_cast continue co_await co_return co_yield decltype default delete do double dynamic_cast else enum explicit export extern false float for friend goto if inline int long mutable namespace new noexcept nullptr operator private protected public register reinterpret_cast requires return short signed sizeof static static_assert static_cast struct switch template this thread_local throw true try typedef typeid typename union unsigned using virtual void volatile wchar_t while final override module import"
CPP_SIGNS = "<=> ... <<= >>= ->* .* -> ++ -- << <= >= == != && || += -= *= /= %= &= ^= |= :: . & * + - ~ ! / % < > ^ | ? : = , ;"

JAVA_WORDS = "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null _ var record sealed permits yield when module open requires transitive exports opens to uses provides with"
JAVA_SIGNS = "... -> :: ++ -- <<= >>>= >>= << <= >= == != && || += -= *= /= %= &= ^= |= + - * / % & | ^ ~ ! < > ? : = , . @ ;"

PYTHON_WORDS = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type _"
PYTHON_SIGNS = "... **= //= >>= <<= -> := ** // << >> <= >= == != += -= *= /= %= @= &= |= ^= + - * / % @ & | ^ ~ < > : , . = ; !"

GO_WORDS = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"
GO_SIGNS = "... <<= >>= &^= &^ <- ++ -- << >> <= >= == != && || += -= *= /= %= &= |= ^= := + - * / % & | ^ < > = ! ~ , . : ;"

C = """
c17 = { external } ;
external = declaration | function ;
function = specs declarator { declaration } block ;
declaration = specs [ initdeclarator { ',' initdeclarator } ] ';' | staticassert ;
staticassert = '_Static_assert' '(' cond ',' STR { STR } ')' ';' ;
specs = { qualifier } core { qualifier } ;
qualifier = 'const' | 'volatile' | 'restrict' | '_Atomic' | 'typedef' | 'extern' | 'static' | 'auto' | 'register' | '_Thread_local' | 'inline' | '_Noreturn' | '_Alignas' '(' ( typename | cond ) ')' ;
core = NAME | builtin { builtin | qualifier } | record | enum | '_Atomic' '(' typename ')' ;
builtin = 'void' | 'char' | 'short' | 'int' | 'long' | 'float' | 'double' | 'signed' | 'unsigned' | '_Bool' | '_Complex' | '_Imaginary' ;
record = ( 'struct' | 'union' ) ( NAME | [ NAME ] '{' member { member } '}' ) ;
member = specs [ field { ',' field } ] ';' | staticassert ;
field = declarator [ ':' cond ] | ':' cond ;
enum = 'enum' ( NAME | [ NAME ] '{' enumerator { ',' enumerator } [ ',' ] '}' ) ;
enumerator = NAME [ '=' cond ] ;
initdeclarator = declarator [ '=' init ] ;
pointer = '*' { 'const' | 'volatile' | 'restrict' | '_Atomic' } ;
declarator = { pointer } ( NAME | '(' declarator ')' ) { suffix } ;
suffix = '[' { 'static' | 'const' | 'volatile' | 'restrict' } [ assign | '*' ] ']' | '(' [ params | NAME { ',' NAME } ] ')' ;
params = param { ',' param } [ ',' '...' ] ;
param = specs ( declarator | [ abstract ] ) ;
abstract = pointer { pointer } [ bare ] | bare ;
bare = ( '(' abstract ')' | suffix ) { suffix } ;
typename = specs [ abstract ] ;
init = assign | braces ;
braces = '{' initlist '}' ;
initlist = item { ',' item } [ ',' ] ;
item = [ designator { designator } '=' ] init ;
designator = '.' NAME | '[' cond ']' ;
block = '{' { declaration | statement } '}' ;
statement = NAME ':' statement | 'case' cond ':' statement | 'default' ':' statement | block | [ expr ] ';'
  | 'if' '(' expr ')' statement [ 'else' statement ] | 'switch' '(' expr ')' statement | 'while' '(' expr ')' statement
  | 'do' statement 'while' '(' expr ')' ';' | 'for' '(' ( declaration | [ expr ] ';' ) [ expr ] ';' [ expr ] ')' statement
  | 'goto' NAME ';' | 'continue' ';' | 'break' ';' | 'return' [ expr ] ';' ;
expr = assign | expr ',' assign ;
assign = { unary assignop } cond ;
assignop = '=' | '*=' | '/=' | '%=' | '+=' | '-=' | '<<=' | '>>=' | '&=' | '^=' | '|=' ;
cond = binary { '?' expr ':' binary } ;
binary = cast | binary binop cast ;
binop = '*' | '/' | '%' | '+' | '-' | '<<' | '>>' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '&' | '^' | '|' | '&&' | '||' ;
cast = { '(' typename ')' } unary ;
unary = ( '++' | '--' ) unary | ( '&' | '*' | '+' | '-' | '~' | '!' ) cast | 'sizeof' ( unary | '(' typename ')' ) | '_Alignof' '(' typename ')' | postfix ;
postfix = primary | '(' typename ')' braces | postfix ( '[' expr ']' | '(' [ assign { ',' assign } ] ')' | '.' NAME | '->' NAME | '++' | '--' ) ;
primary = NAME | NUM | CHAR | STR { STR } | '(' expr ')' | '_Generic' '(' assign ',' choice { ',' choice } ')' ;
choice = ( typename | 'default' ) ':' assign ;
"""

CPP = """
cpp20 = { declaration | moduleimport } ;
cpp20module = [ 'module' ';' { declaration } ] [ 'export' ] 'module' modulename [ ':' modulename ] { attribute } ';' { declaration | moduleimport } [ 'module' ':' 'private' ';' { declaration } ] ;
moduleimport = [ 'export' ] 'import' ( modulename | ':' modulename | STR | '<' name { ( '.' | '/' ) name } '>' ) { attribute } ';' ;
modulename = name { '.' name } ;
name = NAME | 'final' | 'override' | 'module' | 'import' ;
attribute = '[' '[' [ attr { ',' attr } ] ']' ']' | 'alignas' '(' ( typeid | cond ) ')' ;
attr = [ NAME [ '::' NAME ] [ '(' [ exprs ] ')' ] [ '...' ] ] ;
declaration = ';' | variable | binding | function | namespace | using | template | 'extern' STR ( '{' { declaration } '}' | declaration )
  | staticassert | 'asm' '(' STR { STR } ')' ';' | 'export' ( declaration | '{' { declaration } '}' ) | guide | concept ;
staticassert = 'static_assert' '(' assign [ ',' STR { STR } ] ')' ';' ;
guide = [ 'explicit' ] name '(' [ params ] ')' '->' typeid ';' ;
concept = 'concept' name '=' cond ';' ;
namespace = [ 'inline' ] 'namespace' { attribute } [ name { '::' [ 'inline' ] name } ] '{' { declaration } '}' | 'namespace' name '=' qualified ';' ;
using = 'using' ( 'namespace' qualified | [ 'typename' ] qualified { ',' [ 'typename' ] qualified } | name { attribute } '=' typeid | 'enum' qualified ) ';' ;
template = 'template' '<' [ tparams ] '>' [ requires ] declaration | 'template' declaration ;
requires = 'requires' cond ;
tparams = tparam { ',' tparam } ;
tparam = ( 'typename' | 'class' ) [ '...' ] [ name ] [ '=' typeid ] | 'template' '<' [ tparams ] '>' ( 'typename' | 'class' ) [ '...' ] [ name ] [ '=' qualified ] | param ;
specs = { attribute | spec } type { spec } ;
spec = 'const' | 'volatile' | 'static' | 'inline' | 'constexpr' | 'consteval' | 'constinit' | 'extern' | 'register' | 'thread_local' | 'mutable' | 'virtual' | 'friend' | 'typedef' | 'explicit' [ '(' cond ')' ] ;
type = builtin { builtin | spec } | qualified [ 'auto' ] | 'typename' qualified | class | enum | 'auto' | 'decltype' '(' expr ')' ;
builtin = 'void' | 'bool' | 'char' | 'char8_t' | 'char16_t' | 'char32_t' | 'wchar_t' | 'short' | 'int' | 'long' | 'float' | 'double' | 'signed' | 'unsigned' ;
qualified = [ '::' ] part { '::' [ 'template' ] part } ;
part = name [ '<' [ targs ] '>' ] | 'decltype' '(' expr ')' '::' name [ '<' [ targs ] '>' ] ;
targs = targ { ',' targ } ;
targ = ( typeid | cond | braces ) [ '...' ] ;
class = ( 'class' | 'struct' | 'union' ) { attribute } ( qualified | [ qualified [ 'final' ] ] [ ':' base { ',' base } ] '{' { member } '}' ) ;
base = { 'virtual' | 'public' | 'protected' | 'private' } qualified [ '...' ] ;
member = ( 'public' | 'protected' | 'private' ) ':' | declaration | method | membertemplate ;
membertemplate = 'template' '<' [ tparams ] '>' [ requires ] ( method | membertemplate ) ;
method = { attribute | spec } ( [ '~' ] name | 'operator' typeid ) '(' [ params ] ')' { quality } body ;
enum = 'enum' [ 'class' | 'struct' ] { attribute } ( qualified [ ':' typeid ] | [ qualified ] [ ':' typeid ] '{' [ enumerator { ',' enumerator } [ ',' ] ] '}' ) ;
enumerator = name { attribute } [ '=' cond ] ;
variable = specs [ initdeclarator { ',' initdeclarator } ] ';' ;
binding = { spec } 'auto' { spec } [ '&' | '&&' ] '[' name { ',' name } ']' ( '=' assign | '(' assign ')' | braces ) ';' ;
initdeclarator = ( declarator [ '=' clause | '(' [ exprs ] ')' | braces | ':' cond [ '=' clause | braces ] ] | ':' cond ) [ requires ] ;
function = specs declarator body | { attribute | spec } outside '(' [ params ] ')' { quality } body ;
outside = qualified '::' ( '~' name | name | 'operator' typeid ) ;
body = [ requires ] ( [ ':' memberinit { ',' memberinit } ] block | [ '->' typeid ] ';' | 'try' [ ':' memberinit { ',' memberinit } ] block handler { handler } | '=' ( 'default' | 'delete' | NUM ) ';' ) ;
memberinit = qualified ( '(' [ exprs ] ')' | braces ) [ '...' ] ;
pointer = '*' | '&' | '&&' | 'const' | 'volatile' | qualified '::' '*' | '...' | attribute ;
declarator = { pointer } ( declared | '(' declarator ')' ) { suffix } ;
declared = [ qualified '::' ] ( name | '~' name | 'operator' operator ) | qualified ;
operator = 'new' [ '[' ']' ] | 'delete' [ '[' ']' ] | '(' ')' | '[' ']' | '->' | '->*' | '++' | '--' | '~' | '!' | ',' | 'co_await' | '<=>' | assignop | binop | STR | STR name ;
suffix = '[' [ cond ] ']' | '(' [ params ] ')' { quality } ;
quality = 'const' | 'volatile' | '&' | '&&' | 'noexcept' [ '(' cond ')' ] | 'override' | 'final' | 'throw' '(' [ typeid { ',' typeid } ] ')' | '->' typeid | attribute ;
params = param { ',' param } [ [ ',' ] '...' ] | '...' ;
param = specs ( declarator | [ abstract ] ) [ '=' clause ] ;
abstract = pointer { pointer } [ bare ] | bare ;
bare = ( '(' abstract ')' | suffix ) { suffix } ;
typeid = specs [ abstract ] ;
block = '{' { statement } '}' ;
statement = { attribute } ( name ':' statement | 'case' cond ':' statement | 'default' ':' statement | block | [ expr ] ';'
  | 'if' [ 'constexpr' | 'consteval' | '!' 'consteval' ] [ '(' [ first ] condition ')' ] statement [ 'else' statement ]
  | 'switch' '(' [ first ] condition ')' statement | 'while' '(' condition ')' statement | 'do' statement 'while' '(' expr ')' ';'
  | 'for' '(' first [ condition ] ';' [ expr ] ')' statement | 'for' '(' [ first ] { attribute } range ':' ( expr | braces ) ')' statement
  | 'goto' name ';' | 'continue' ';' | 'break' ';' | 'return' [ expr | braces ] ';' | 'co_return' [ expr | braces ] ';'
  | 'try' block handler { handler } | variable | binding | using | staticassert | 'namespace' name '=' qualified ';' | 'asm' '(' STR ')' ';' ) ;
first = variable | binding | [ expr ] ';' | using ;
condition = expr | specs declarator ( '=' clause | braces ) ;
range = specs declarator | { spec } 'auto' { spec } [ '&' | '&&' ] '[' name { ',' name } ']' ;
handler = 'catch' '(' ( '...' | param ) ')' block ;
expr = assign { ',' assign } ;
exprs = clause [ '...' ] { ',' clause [ '...' ] } ;
clause = assign | braces ;
braces = '{' [ item { ',' item } [ ',' ] ] '}' ;
item = '.' name ( '=' clause | braces ) | clause [ '...' ] ;
assign = { binary assignop } ( cond | braces ) | { binary assignop } 'throw' [ assign ] | { binary assignop } 'co_yield' clause ;
assignop = '=' | '*=' | '/=' | '%=' | '+=' | '-=' | '<<=' | '>>=' | '&=' | '^=' | '|=' ;
cond = binary [ '?' expr ':' assign ] ;
binary = cast { binop cast } ;
binop = '*' | '/' | '%' | '+' | '-' | '<<' | '>' '>' | '<' | '>' | '<=' | '>=' | '<=>' | '==' | '!=' | '&' | '^' | '|' | '&&' | '||' | '.*' | '->*' ;
cast = { '(' typeid ')' } unary ;
unary = ( '++' | '--' | '&' | '&&' | '*' | '+' | '-' | '~' | '!' | 'co_await' ) cast | 'sizeof' ( unary | '(' typeid ')' | '...' '(' name ')' ) | 'alignof' '(' typeid ')' | 'noexcept' '(' expr ')'
  | [ '::' ] 'new' [ '(' exprs ')' ] ( newtype | '(' typeid ')' ) [ '(' [ exprs ] ')' | braces ] | [ '::' ] 'delete' [ '[' ']' ] cast | postfix ;
newtype = { spec } type { spec } { pointer } { '[' [ cond ] ']' } ;
postfix = primary { '[' [ exprs ] ']' | '(' [ exprs ] ')' | '.' [ 'template' ] identifier | '->' [ 'template' ] identifier | '++' | '--' } ;
identifier = qualified | [ qualified '::' ] ( '~' name | 'operator' operator | 'operator' typeid ) ;
primary = NUM | CHAR | STR { STR } | 'this' | 'nullptr' | 'true' | 'false' | '(' expr ')' | identifier | lambda | demand
  | ( 'static_cast' | 'dynamic_cast' | 'const_cast' | 'reinterpret_cast' ) '<' typeid '>' '(' expr ')' | 'typeid' '(' ( typeid | expr ) ')'
  | ( builtin | 'typename' qualified | 'auto' | 'decltype' '(' expr ')' ) ( '(' [ exprs ] ')' | braces ) | qualified braces
  | '(' '...' binop cast ')' | '(' cast binop '...' [ binop cast ] ')' ;
lambda = '[' [ capture { ',' capture } ] ']' [ '<' tparams '>' [ requires ] ] { attribute } [ '(' [ params ] ')' ] { 'mutable' | 'constexpr' | 'consteval' | 'static' | quality } [ requires ] block ;
capture = '&' | '=' | [ '&' ] [ '...' ] name [ '=' clause | braces | '(' [ exprs ] ')' ] [ '...' ] | 'this' | '*' 'this' ;
demand = 'requires' [ '(' [ params ] ')' ] '{' need { need } '}' ;
need = expr ';' | 'typename' qualified ';' | '{' expr '}' [ 'noexcept' ] [ '->' qualified ] ';' | 'requires' cond ';' ;
"""

JAVA = """
java21 = [ package ] { import | ';' } { toplevel } ;
java21module = { import | ';' } { annotation } [ 'open' ] 'module' qualified '{' { directive } '}' ;
directive = 'requires' { 'transitive' | 'static' } qualified ';' | ( 'exports' | 'opens' ) qualified [ 'to' qualified { ',' qualified } ] ';' | 'uses' qualified ';' | 'provides' qualified 'with' qualified { ',' qualified } ';' ;
name = NAME | 'var' | 'record' | 'sealed' | 'permits' | 'yield' | 'when' | 'module' | 'open' | 'requires' | 'transitive' | 'exports' | 'opens' | 'to' | 'uses' | 'provides' | 'with' ;
qualified = name { '.' name } ;
package = { annotation } 'package' qualified ';' ;
import = 'import' [ 'static' ] qualified [ '.' '*' ] ';' ;
toplevel = typedecl | ';' ;
modifier = annotation | 'public' | 'protected' | 'private' | 'static' | 'abstract' | 'final' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | NAME '-' 'sealed' ;
annotation = '@' qualified [ '(' [ avalue | pair { ',' pair } ] ')' ] ;
pair = name '=' avalue ;
avalue = cond | annotation | '{' [ avalue { ',' avalue } ] [ ',' ] '}' ;
typedecl = { modifier } ( class | enum | record | interface | annotationtype ) ;
class = 'class' name [ tparams ] [ 'extends' type ] [ 'implements' types ] [ 'permits' types ] classbody ;
enum = 'enum' name [ 'implements' types ] '{' [ constant { ',' constant } ] [ ',' ] [ ';' { member } ] '}' ;
constant = { annotation } name [ arguments ] [ classbody ] ;
record = 'record' name [ tparams ] '(' [ component { ',' component } ] ')' [ 'implements' types ] classbody ;
component = { annotation } type [ { annotation } '...' ] name ;
interface = 'interface' name [ tparams ] [ 'extends' types ] [ 'permits' types ] classbody ;
annotationtype = '@' 'interface' name '{' { amember | member } '}' ;
amember = { modifier } type name '(' ')' { dims } [ 'default' avalue ] ';' ;
classbody = '{' { member } '}' ;
member = ';' | typedecl | { modifier } field | { modifier } method | { modifier } constructor | [ 'static' ] block | { modifier } name block ;
field = type declarators ';' ;
declarators = declarator { ',' declarator } ;
declarator = name { dims } [ '=' init ] ;
init = expr | '{' [ init { ',' init } ] [ ',' ] '}' ;
method = [ tparams { annotation } ] ( type | 'void' ) name '(' [ params ] ')' { dims } [ 'throws' types ] ( block | ';' ) ;
constructor = [ tparams ] name '(' [ params ] ')' [ 'throws' types ] block ;
params = param { ',' param } ;
param = { annotation | 'final' } type ( [ { annotation } '...' ] name { dims } | [ name '.' ] 'this' ) ;
tparams = '<' tparam { ',' tparam } '>' ;
tparam = { annotation } name [ 'extends' type { '&' type } ] ;
dims = { annotation } '[' ']' ;
types = type { ',' type } ;
type = { annotation } ( primitive | part { '.' { annotation } part } ) { dims } ;
part = name [ targs ] ;
targs = '<' [ targ { ',' targ } ] '>' ;
targ = type | { annotation } '?' [ ( 'extends' | 'super' ) type ] ;
primitive = 'boolean' | 'byte' | 'short' | 'int' | 'long' | 'char' | 'float' | 'double' ;
block = '{' { blockstatement } '}' ;
blockstatement = local ';' | localtype | statement ;
local = { annotation | 'final' } type declarators ;
localtype = { modifier } ( class | enum | record | interface ) ;
statement = block | ';' | name ':' statement | expression ';' | 'if' '(' expr ')' statement [ 'else' statement ] | 'assert' expr [ ':' expr ] ';'
  | switch | 'while' '(' expr ')' statement | 'do' statement 'while' '(' expr ')' ';' | 'for' '(' [ forinit ] ';' [ expr ] ';' [ expression { ',' expression } ] ')' statement
  | 'for' '(' { annotation | 'final' } type name { dims } ':' expr ')' statement | 'break' [ name ] ';' | 'continue' [ name ] ';' | 'return' [ expr ] ';' | 'throw' expr ';'
  | 'synchronized' '(' expr ')' block | 'try' block ( catch { catch } [ 'finally' block ] | 'finally' block ) | 'try' '(' resource { ';' resource } [ ';' ] ')' block { catch } [ 'finally' block ] | 'yield' expr ';' ;
forinit = local | expression { ',' expression } ;
catch = 'catch' '(' { annotation | 'final' } type { '|' type } name ')' block ;
resource = local | expr ;
switch = 'switch' '(' expr ')' '{' ( { label ':' { label ':' } { blockstatement } } | rule { rule } ) '}' ;
rule = label '->' ( expr ';' | block | 'throw' expr ';' ) ;
label = 'case' ( cond { ',' cond } | 'null' [ ',' 'default' ] | pattern { ',' pattern } [ 'when' expr ] ) | 'default' ;
pattern = { annotation | 'final' } type name | type '(' [ pattern { ',' pattern } ] ')' ;
expression = unary assignop expr | ( '++' | '--' ) unary | effect ;
effect = primary ( '++' | '--' ) | called ;
called = base { select } last ;
last = arguments | '.' [ targs ] name arguments | '.' 'super' arguments | '.' 'new' creator ;
expr = lambda | { unary assignop } ( cond | lambda ) ;
assignop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '>' '>' '>=' | '>>=' | '>>>=' ;
lambda = ( name | '_' | '(' [ params | lname { ',' lname } ] ')' ) '->' ( expr | block ) ;
lname = name | '_' ;
cond = binary [ '?' expr ':' ( cond | lambda ) ] ;
binary = unary { binop unary | 'instanceof' ( [ 'final' ] type [ name ] | pattern ) } ;
binop = '*' | '/' | '%' | '+' | '-' | '<<' | '>' '>' | '>' '>' '>' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '&' | '^' | '|' | '&&' | '||' ;
unary = ( '++' | '--' | '+' | '-' | '~' | '!' ) unary | '(' type { '&' type } ')' ( unary | lambda ) | primary { '++' | '--' } | switchexpr ;
switchexpr = switch ;
primary = base { select } ;
select = '.' name | '.' [ targs ] name arguments | '[' expr ']' | '.' 'this' | '.' 'super' [ arguments ] | '.' 'class' | '.' 'new' creator | '::' [ targs ] ( name | 'new' ) ;
base = NUM | CHAR | STR | 'true' | 'false' | 'null' | 'this' [ arguments ] | 'super' [ arguments ] | [ targs ] name arguments | name | '(' expr ')' | 'new' creator
  | type '::' [ targs ] ( name | 'new' ) | type '.' 'class' | 'void' '.' 'class' ;
arguments = '(' [ expr { ',' expr } ] ')' ;
creator = { annotation } ( part { '.' part } arguments [ classbody ] | ( primitive | part { '.' part } ) ( { annotation } '[' expr ']' { { annotation } '[' expr ']' } { dims } | dims { dims } '{' [ init { ',' init } ] [ ',' ] '}' ) ) ;
"""

PYTHON = """
python313 = { statement } ;
fexpression = yields | starred { ',' starred } [ ',' ] ;
statement = compound | simple ;
simple = small { ';' small } [ ';' ] NEWLINE ;
block = simple | NEWLINE INDENT statement { statement } DEDENT ;
name = NAME | 'match' | 'case' | 'type' | '_' ;
small = { targets '=' } ( yields | stars ) | single augmented ( yields | stars ) | ( name | '(' single ')' | reached ) ':' expr [ '=' ( yields | stars ) ]
  | 'type' name [ tparams ] '=' expr | 'return' [ stars ] | 'import' dotted [ 'as' name ] { ',' dotted [ 'as' name ] } | from | 'raise' [ expr [ 'from' expr ] ] | 'pass'
  | 'del' deleted { ',' deleted } [ ',' ] | 'assert' expr [ ',' expr ] | 'break' | 'continue' | ( 'global' | 'nonlocal' ) name { ',' name } ;
augmented = '+=' | '-=' | '*=' | '/=' | '%=' | '@=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '**=' | '//=' ;
dotted = name { '.' name } ;
from = 'from' ( { '.' | '...' } dotted | ( '.' | '...' ) { '.' | '...' } ) 'import' ( '*' | '(' alias { ',' alias } [ ',' ] ')' | alias { ',' alias } ) ;
alias = name [ 'as' name ] ;
compound = 'if' named ':' block { 'elif' named ':' block } [ 'else' ':' block ] | 'while' named ':' block [ 'else' ':' block ]
  | [ 'async' ] 'for' targets 'in' stars ':' block [ 'else' ':' block ] | [ 'async' ] 'with' ( item { ',' item } | '(' item { ',' item } [ ',' ] ')' ) ':' block
  | 'try' ':' block ( 'finally' ':' block | except { except } [ 'else' ':' block ] [ 'finally' ':' block ] | group { group } [ 'else' ':' block ] [ 'finally' ':' block ] )
  | { '@' named NEWLINE } ( function | class ) | match ;
item = expr [ 'as' target ] ;
except = 'except' [ expr [ 'as' name ] ] ':' block ;
group = 'except' '*' expr [ 'as' name ] ':' block ;
function = [ 'async' ] 'def' name [ tparams ] '(' [ params ] ')' [ '->' expr ] ':' block ;
class = 'class' name [ tparams ] [ '(' [ args ] ')' ] ':' block ;
tparams = '[' tparam { ',' tparam } [ ',' ] ']' ;
tparam = name [ ':' expr ] [ '=' expr ] | '*' name [ '=' ( '*' bits | expr ) ] | '**' name [ '=' expr ] ;
params = positional [ ',' ] | keyword [ ',' ] ;
p = name [ ':' expr ] ;
d = p '=' expr ;
positional = p { ',' p } [ ',' '/' { ',' p } ] { ',' d } [ ',' keyword ] | p { ',' p } ',' d { ',' d } ',' '/' { ',' d } [ ',' keyword ] | d { ',' d } [ ',' '/' { ',' d } ] [ ',' keyword ] ;
keyword = '*' name [ ':' ( expr | '*' bits ) ] { ',' ( p | d ) } [ ',' '**' p ] | '*' ',' ( p | d ) { ',' ( p | d ) } [ ',' '**' p ] | '**' p ;
lambda = 'lambda' [ lparams ] ':' expr ;
lparams = lpositional [ ',' ] | lkeyword [ ',' ] ;
l = name '=' expr ;
lpositional = name { ',' name } [ ',' '/' { ',' name } ] { ',' l } [ ',' lkeyword ] | name { ',' name } ',' l { ',' l } ',' '/' { ',' l } [ ',' lkeyword ] | l { ',' l } [ ',' '/' { ',' l } ] [ ',' lkeyword ] ;
lkeyword = '*' name { ',' ( name | l ) } [ ',' '**' name ] | '*' ',' ( name | l ) { ',' ( name | l ) } [ ',' '**' name ] | '**' name ;
match = 'match' ( starnamed ',' [ starnamed { ',' starnamed } [ ',' ] ] | named ) ':' NEWLINE INDENT case { case } DEDENT ;
case = 'case' patterns [ 'if' named ] ':' block ;
patterns = pattern | sequence ;
sequence = many ',' [ many { ',' many } [ ',' ] ] ;
many = '*' name | pattern ;
pattern = closed { '|' closed } [ 'as' name ] ;
closed = [ '-' ] NUM [ ( '+' | '-' ) NUM ] | strings | 'None' | 'True' | 'False' | dotted [ '(' [ parg { ',' parg } [ ',' ] ] ')' ] | '(' [ pattern | sequence ] ')' | '[' [ many { ',' many } [ ',' ] ] ']' | '{' [ pkey { ',' pkey } [ ',' ] ] '}' ;
parg = pattern | name '=' pattern ;
pkey = ( [ '-' ] NUM [ ( '+' | '-' ) NUM ] | strings | 'None' | 'True' | 'False' | name '.' dotted ) ':' pattern | '**' name ;
targets = startarget { ',' startarget } [ ',' ] ;
startarget = [ '*' ] target ;
target = name | '(' [ targets ] ')' | '[' [ targets ] ']' | reached ;
single = name | '(' single ')' | reached ;
reached = atom { trailer } ( '.' name | '[' slices ']' ) ;
deleted = name | reached | '(' [ deleted { ',' deleted } [ ',' ] ] ')' | '[' [ deleted { ',' deleted } [ ',' ] ] ']' ;
yields = 'yield' ( 'from' expr | [ stars ] ) ;
stars = starred { ',' starred } [ ',' ] ;
starred = '*' bits | expr ;
starnamed = '*' bits | named ;
named = name ':=' expr | expr ;
expr = logic [ 'if' logic 'else' expr ] | lambda ;
logic = { 'not' } comparison { ( 'and' | 'or' ) { 'not' } comparison } ;
comparison = bits { ( '==' | '!=' | '<' | '<=' | '>' | '>=' | 'in' | 'not' 'in' | 'is' | 'is' 'not' ) bits } ;
bits = unary { ( '|' | '^' | '&' | '<<' | '>>' | '+' | '-' | '*' | '/' | '//' | '%' | '@' ) unary } ;
unary = { '+' | '-' | '~' } [ 'await' ] atom { trailer } [ '**' unary ] ;
trailer = '.' name | '(' [ args ] ')' | '[' slices ']' ;
atom = name | 'True' | 'False' | 'None' | '...' | NUM | strings | '(' [ yields | named [ comprehension ] | starnamed ',' [ starnamed { ',' starnamed } [ ',' ] ] ] ')'
  | '[' [ starnamed { ',' starnamed } [ ',' ] | named comprehension ] ']' | '{' [ entry { ',' entry } [ ',' ] | expr ':' expr comprehension | starnamed { ',' starnamed } [ ',' ] | named comprehension ] '}' ;
strings = STR { STR } | BYTES { BYTES } ;
entry = expr ':' expr | '**' bits ;
comprehension = one { one } ;
one = [ 'async' ] 'for' targets 'in' logic { 'if' logic } ;
args = named comprehension | arg { ',' arg } [ ',' kwargs ] [ ',' ] | kwargs [ ',' ] ;
arg = '*' expr | named ;
kwargs = kwarg { ',' kwarg } { ',' kwpair } | kwpair { ',' kwpair } ;
kwarg = name '=' expr | '*' expr ;
kwpair = name '=' expr | '**' expr ;
slices = slice | ( slice | '*' bits ) ',' [ ( slice | '*' bits ) { ',' ( slice | '*' bits ) } [ ',' ] ] | '*' bits ;
slice = [ expr ] ':' [ expr ] [ ':' [ expr ] ] | named ;
"""

GO = """
go122 = 'package' NAME ';' { import ';' } { toplevel ';' } ;
import = 'import' ( importspec | '(' [ importspec { ';' importspec } [ ';' ] ] ')' ) ;
importspec = [ '.' | NAME ] STR ;
toplevel = declaration | 'func' NAME [ tparams ] signature [ block ] | 'func' params NAME signature [ block ] ;
declaration = 'const' ( constspec | '(' [ constspec { ';' constspec } [ ';' ] ] ')' ) | 'type' ( typespec | '(' [ typespec { ';' typespec } [ ';' ] ] ')' ) | 'var' ( varspec | '(' [ varspec { ';' varspec } [ ';' ] ] ')' ) ;
names = NAME { ',' NAME } ;
constspec = names [ [ type ] '=' exprs ] ;
typespec = NAME [ tparams ] [ '=' ] type ;
varspec = names ( type [ '=' exprs ] | '=' exprs ) ;
tparams = '[' tparam { ',' tparam } [ ',' ] ']' ;
tparam = names constraint ;
constraint = [ '~' ] type { '|' [ '~' ] type } ;
signature = params [ result ] ;
result = params | type ;
params = '(' [ param { ',' param } [ ',' ] ] ')' ;
param = type | NAME [ '...' ] type | '...' type ;
type = typename | '*' type | '[' ']' type | '[' ( expr | '...' ) ']' type | 'map' '[' type ']' type | [ '<-' ] 'chan' [ '<-' ] type | 'func' signature | struct | interface | '(' type ')' ;
typename = NAME [ '.' NAME ] [ '[' type { ',' type } [ ',' ] ']' ] ;
struct = 'struct' '{' [ field { ';' field } [ ';' ] ] '}' ;
field = ( names type | [ '*' ] typename ) [ STR ] ;
interface = 'interface' '{' [ element { ';' element } [ ';' ] ] '}' ;
element = NAME signature | constraint ;
block = '{' list '}' ;
list = [ statement ] { ';' [ statement ] } ;
statement = declaration | NAME ':' [ statement ] | small | 'go' expr | 'defer' expr | 'return' [ exprs ] | 'break' [ NAME ] | 'continue' [ NAME ] | 'goto' NAME | 'fallthrough' | block | if
  | 'switch' [ [ small ] ';' ] [ expr ] '{' { ( 'case' exprs | 'default' ) ':' list } '}' | 'switch' [ [ small ] ';' ] [ NAME ':=' ] operand { selector } '.' '(' 'type' ')' '{' { ( 'case' type { ',' type } | 'default' ) ':' list } '}'
  | 'select' '{' { ( 'case' communication | 'default' ) ':' list } '}' | 'for' [ expr | [ small ] ';' [ expr ] ';' [ small ] | [ exprs ( '=' | ':=' ) ] 'range' expr ] block ;
if = 'if' [ [ small ] ';' ] expr block [ 'else' ( if | block ) ] ;
communication = exprs ( '=' | ':=' ) expr | expr '<-' expr | expr ;
small = expr | expr '<-' expr | expr ( '++' | '--' ) | exprs assignop exprs | names ':=' exprs ;
assignop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^=' ;
exprs = expr { ',' expr } ;
expr = unary { binop unary } ;
binop = '||' | '&&' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '+' | '-' | '|' | '^' | '*' | '/' | '%' | '<<' | '>>' | '&' | '&^' ;
unary = { '+' | '-' | '!' | '^' | '*' | '&' | '<-' } operand { selector } ;
operand = NUM | CHAR | STR | NAME | '(' expr ')' | '(' type ')' | 'func' signature block | literaltype braces | conversion ;
literaltype = struct | '[' ']' type | '[' ( expr | '...' ) ']' type | 'map' '[' type ']' type ;
conversion = ( '[' ']' type | '[' expr ']' type | 'map' '[' type ']' type | 'chan' [ '<-' ] type | '<-' 'chan' type | interface | struct | 'func' signature ) '(' expr [ ',' ] ')' ;
selector = '.' NAME | '.' '(' type ')' | '[' expr ']' | '[' type { ',' type } [ ',' ] ']' | '[' [ expr ] ':' [ expr ] ']' | '[' [ expr ] ':' expr ':' expr ']' | '(' [ ( exprs | type { ',' expr } ) [ '...' ] [ ',' ] ] ')' | braces ;
braces = '{' [ element2 { ',' element2 } [ ',' ] ] '}' ;
element2 = [ ( expr | braces ) ':' ] ( expr | braces ) ;
"""
