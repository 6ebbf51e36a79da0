"""Productions of eight languages over token classes, reductions, and permissible pairs of tokens.

A rule is a regular expression in which <name> stands for another rule, <name!k>
for a group that fits the kind k. Rules are expanded, never recursive.
"""

from __future__ import annotations

import re
from functools import lru_cache

from gneiss.llm.grammar import WORDS

BRACE, PAREN = "0", "ΰ"  # bases of the characters of reduced groups
_BRACES = {k: "[" + "".join(chr(ord(BRACE) + m) for m in range(1, 8) if m & k) + "]" for k in (1, 2, 4)}
_PARENS = {k: "[" + "".join(chr(ord(PAREN) + m) for m in range(1, 8) if m & k) + "]" for k in (1, 2, 4)}

# what every language shares: <blk> block, <obj> literal or list, <body> members; <args>, <params>, <head> of a loop or other
_SHARED = {"blk": _BRACES[1], "obj": _BRACES[2], "body": _BRACES[4], "args": _PARENS[1], "params": _PARENS[2], "head": _PARENS[4]}

_JS = {
    "w": r"[iMjzdxmoFKRIWfSCthyEObUBvnqwYLJ]",
    "id": "[izjMYwqLJ]", "type": "(?!)", "ann": "", "gen": "", "dots": "e?",
    "fun": r"j?FX?[iz]?<gen><params><ann><blk>",
    "arrow": r"j?(?:[izM]|<gen><params><ann>)a",
    "prim": r"(?:[inszMjwYq](?!a)|Q|<args>|<obj>|<fun>|<arrow><blk>|K[iz]?<gen>(?:x<heir>)*<body>|m<args>|mD)",
    "heir": r"(?:[in]|<args>)(?:D|<args>)*",
    "suf": r"(?:D|Q|<args>|s|p)",
    "un": r"(?:[XUp]|<arrow>)",
    "bin": r"(?:[BXlg=]|ggg?)",
    "seq": r"<un>*<prim><suf>*(?:<bin><un>*<prim><suf>*)*",
    "expr": r"<seq>(?:T<seq>(?:T<seq>:<seq>)*:<seq>)*",
    "list": r"(?:e?<expr>(?:,e?<expr>)*,?)?",
    "pat": r"(?:[izMjw]|<obj>|Q)",
    "decl": r"<pat><ann>(?:=<expr>)?",
    "param": r"e?<pat><ann>(?:=<expr>)?",
    "p1": "<list>", "p2": r"(?:<param>(?:,<param>)*,?)?",
    "p4": r"(?:v<decl>(?:,<decl>)*|<expr>(?:,<expr>)*)?;(?:<expr>(?:,<expr>)*)?;(?:<expr>(?:,<expr>)*)?|v?(?:<pat>|<prim><suf>*)[zB]<expr>",
    "q": r",*(?:e?<expr>(?:,+e?<expr>)*,*)?",
    "key": r"(?:<w>|s|n|Q)",
    "fn": r"(?:M|j|X)*<key><gen><params><ann><blk>",
    "b2": r"(?:(?:e<expr>|<key>(?::<expr>)?|<key>=<expr>|<key>w<w>|<key>:<pat>=<expr>|<fn>)(?:,(?:e<expr>|<key>(?::<expr>)?|<key>=<expr>|<key>w<w>|<key>:<pat>=<expr>|<fn>))*,?)?",
    "s2": r"(?:;|<blk>|I<args>|E|W<args>|fU?<head>|O|t<blk>|h<params>?<blk>|y<blk>|S<args><blk>|[iz]:|<decls>|C<expr>:|d:)",
    "decls": r"o?d?<fun>|o?d?K[iz]?<gen>(?:x<heir>)*<body>",
    "s1": r"(?:o?v<decl>(?:,<decl>)*|(?![234567FK]|jF)<expr>(?:,<expr>)*|R(?:<expr>(?:,<expr>)*)?|b[iz]?|ms|m(?:<id>|<obj>|Xw<id>)(?:,(?:<obj>|Xw<id>))?qs|od<expr>|o<obj>(?:qs)?|oX(?:w<w>)?qs)",
    "b1": r"(?:(?><s2>)*+(?><s1>;))*+(?><s2>)*+(?:<s1>)?",
    "b4": r"(?>;|<fn>;?|M*<key>(?:=<expr>)?;|M<blk>)*(?:M*<key>(?:=<expr>)?)?",
    "top": "<b1>",
}

_TS = _JS | {
    "gen": "G?", "ann": r"(?:[TU]?:<type>)?",
    "atom": r"(?:[inszjwYqLM]|[2-7]|Q|[α-η]a?)[DGQ]*",
    "type": r"[BX]?(?:[MUX]*(?:[inszjwYqLM]|[2-7]|Q|[α-η]a?)[DGQ]*(?:[BXxT]|B(?=:))?)+",
    "w": r"[iMjzdxmoFKRIWfSCthyEObUBvnqwYLJk]",
    "suf": r"(?:D|Q|G?<args>|G?s|p|U(?![insUX])|w(?:v|<type>))",
    "arrow": r"j?(?:[izM]|<gen><params><ann>)a",
    "param": r"(?:M)*e?(?:<pat>|n)<ann>(?:=<expr>)?",
    "prim": r"(?:[inszMjwYqL](?!a)|Q|<args>|<obj>|<fun>|<arrow><blk>|K[iz]?<gen>(?:x<heir>)*<body>|m<args>|mD|G<un>*[ins])",
    "heir": r"(?:[in]|<args>)(?:D|<args>)*G?(?:,[in]D*G?)*",
    "fun": r"j?FX?[iz]?<gen><params><ann><blk>",
    "decls": r"(?:o|M)*d?(?:<fun>|j?F[iz]<gen><params><ann>;|M?K[iz]?<gen>(?:x<heir>)*<body>|L[is]D*<gen>(?:x<atom>(?:,<atom>)*)?(?:<body>|<blk>)|(?:v)?J[iz]<obj>)",
    "s1": _JS["s1"][:-1] + r"|(?:o|M)*Y[iz]<gen>=<type>|mY(?:<id>|<obj>|Xw<id>)qs|oY<obj>(?:qs)?|M*o?M*v<decl>(?:,<decl>)*)",
    "fn": r"(?:M|j|X)*<key>T?<gen><params><ann><blk>",
    "b2": _JS["b2"][:-2] + r"|Y[iz](?:w<w>)?(?:,Y?[iz](?:w<w>)?)*,?)?",
    "mem": r"(?:M*(?:U?)<key>[TU]?<gen>(?:<params>)?:<type>|(?:M|j|X)*<key>T?<gen><params><ann>|U?<gen><params>:<type>|Q:<type>|M*<key>[TU]?(?::<type>)?(?:=<expr>)?)",
    "b4": r"(?>;|<fn>;?|<mem>[;,]|M<blk>)*(?:<mem>)?",
    "q": r",*(?:e?<expr>(?:,+e?<expr>)*,*)?|(?:e?<type>(?:,e?<type>)*)?|[iz]:<type>|[iz][zB]?U?<type>(?:w<type>)?",
}

_JAVA = {
    "ann": r"(?:A<args>?)*", "m": r"(?:[MdD]|A<args>?|iX(?=i))*",
    "type": r"A*iG?(?:D+G?)*(?:A*Q)*e?",
    "name": r"iQ*",
    "lam": r"(?:i|<params>)r",
    "new": r"N<ann>i?(?:G?D)*G?(?:<args><body>?|Q+<obj>?)|Ni(?:G?D)*G?(?:<args><body>?|Q+<obj>?)",
    "prim": r"(?:[ins](?![r])|<args>|<new>|<lam><blk>|S<args><blk>|iG?(?:D+G?)*Q+c[iN])",
    "suf": r"(?:D|G<args>|GD|Q|<args>|p|G?c(?:i|N))",
    "un": r"(?:[XUp]|<lam>|<args>(?=[insXUNα-ηS]))",
    "bin": r"(?:[BXlg=]|ggg?|ggg?=)",
    "seq": r"<un>*<prim><suf>*(?:<bin>M*<un>*<prim><suf>*i?)*",
    "expr": r"<seq>(?:T<seq>(?:T<seq>:<seq>)*:<seq>)*",
    "init": r"(?:<expr>|<obj>)",
    "list": r"(?:<expr>(?:,<expr>)*)?",
    "vars": r"<m><type><name>(?:=<init>)?(?:,<name>(?:=<init>)?)*",
    "p1": "<list>", "p2": r"(?:<m><type>(?:i|n)Q*(?:,<m><type>(?:i|n)Q*)*|i(?:,i)*)?",
    "p4": r"(?:<vars>|<expr>(?:,<expr>)*)?;(?:<expr>)?;(?:<expr>(?:,<expr>)*)?|<m><type>i:<expr>|<m><type>(?:B<type>)*i|(?:<vars>|[in]D*)(?:;(?:<vars>|[in]D*))*;?",
    "q": r"(?:<expr>)?",
    "b2": r"(?:<init>(?:,<init>)*,?)?",
    "kls": r"<m>(?:K|@K)iG?<params>?(?:x<type>(?:,<type>)*)*<body>",
    "case": r"(?:C(?:<expr>|d)(?:,(?:<expr>|d))*|C<type>i|d)",
    "s2": r"(?:;|<blk>|I<args>|E|W<args>|f<head>|O|t<head>?<blk>|h<head><blk>|y<blk>|S<args><blk>|i:|<case>:|<case>r(?=[^;])|<kls>|M<args><blk>)",
    "s1": r"(?:<vars>|<expr>|R(?:<expr>(?::<expr>)?)?|bi?)",
    "b1": r"(?:(?><s2>)*+(?><s1>;))*+(?><s2>)*+",
    "meth": r"<m>G?(?:<type>)?i<params>?Q*(?:x<type>(?:,<type>)*)?(?:<blk>|;|d(?:<init>|A<args>?);)",
    "enum": r"(?:<ann>i<args>?<body>?(?:,<ann>i<args>?<body>?)*,?;?)?",
    "b4": r"<enum>(?>;|M?<blk>|<vars>;|<meth>|<kls>)*+",
    "top": r"(?:<ann>kiD*;)?(?:mM?iD*(?:oX)?;|;)*(?><kls>|;)*+",
}

_CSHARP = {
    "m": r"(?:M|QM*)*", "type": r"(?:i(?:c i)?G?(?:D+G?)*|<params>|<args>)T?(?:Q*)T?X*",
    "lam": r"(?:M*(?:i|<params>))a",
    "new": r"N(?:i(?:G?D)*G?T?)?(?:<args>(?:<obj>|<body>)?|Q+(?:<obj>)?|<obj>)",
    "prim": r"(?:[ins](?!a)|<args>|<new>|<lam><blk>|Q|d<args>?)",
    "suf": r"(?:D|G<args>|GD|Q|T?Q|<args>|p|U(?![ins])|S<obj>|c i)",
    "un": r"(?:[XUpM]|<lam>|<args>(?=[insXUNα-η]))",
    "bin": r"(?:[BXlg=]|ggg?|ggg?=)",
    "seq": r"<un>*<prim><suf>*(?:<bin><un>*(?:<prim>|<obj>|<body>|<type>)<suf>*i?)*",
    "expr": r"<seq>(?:T(?:<seq>|R<seq>)(?:T<seq>:<seq>)*:<seq>)*(?:B?R<seq>)?",
    "init": r"(?:<expr>|<obj>)",
    "arg": r"(?:i:)?(?:M*<type>i|M*<expr>)",
    "vars": r"<m><type>iQ*(?:=<init>)?(?:,iQ*(?:=<init>)?)*",
    "p1": r"(?:<arg>(?:,<arg>)*)?", "p2": r"(?:(?:<m>n?<type>i(?:=<expr>)?)(?:,<m><type>i(?:=<expr>)?)*|i(?:,i)*|(?:<type>i?)(?:,<type>i?)*)?",
    "p4": r"(?:<vars>|<expr>(?:,<expr>)*)?;(?:<expr>)?;(?:<expr>(?:,<expr>)*)?|<m><type>(?:i|<args>)B<expr>|<type>i?|<vars>",
    "q": r"(?:e?<expr>(?:,e?<expr>)*|,*|i:(?:<expr>)(?:,<expr>)*)?",
    "b2": r"(?:(?:<init>|Q=<init>|<obj>|<expr>a<expr>)(?:,(?:<init>|Q=<init>|<obj>|<expr>a<expr>))*,?)?",
    "whe": r"(?:xi:(?:[iKd]G?|N<args>|<type>)(?:,(?:[iK]|N<args>|<type>))*)*",
    "kls": r"<m>K+iG?<params>?(?::<type><args>?(?:,<type>)*)?<whe>(?:<body>|<blk>|;)",
    "s2": r"(?:;|<blk>|I<args>|E|W<args>|U?f<head>|O|t<blk>|h<head>?(?:i<args>)?<blk>|y<blk>|S<args><blk>|i:|C(?:<type>i?|<expr>)(?:i<expr>)?:|d:|<kls>|m<head><blk>|<meth>|M<blk>)",
    "s1": r"(?:U?m?<vars>|U?<expr>|U?R(?:<expr>)?|U?bi?|Rb|i[Rb]<expr>?|RC<expr>|Rd)",
    "b1": r"(?:(?><s2>)*+(?><s1>;))*+(?><s2>)*+",
    "acc": r"(?:<m>i(?:;|<blk>|a<expr>;))",
    "meth": r"<m>(?:<type>)?(?:i(?:D)?|[XBlgU=]+)G?<params>(?::n<args>)?<whe>(?:<blk>|;|a<expr>;)",
    "b4": r"(?>;|<vars>;|<m><type>(?:iD?|n Q|nQ)(?:<body>|<blk>)(?:=<init>;)?|<m><type>(?:iD?|nQ)a<expr>;|<meth>|<kls>|U i<params><blk>|Ui<args><blk>|<acc>)*+|(?:Q*i(?:=<expr>)?(?:,Q*i(?:=<expr>)?)*,?)?",
    "use": r"(?:M*mM?(?:i=)?<type>;|Q(?=[mkMKQ]))",
    "top": r"(?><use>|;)*+(?>kiD*(?:;|<body>|<blk>)|<kls>|Q|<s2>|(?!i)<s1>;|<expr>;|<vars>;|<use>)*+",
}

_C = {
    "ds": r"(?:M|i|ki?(?:<body>|<obj>)?)+", "dtor": r"(?:X|M)*(?:i|<args>|<params>)(?:Q|<params>|<args>)*",
    "prim": r"(?:[ins]s*|<args>(?:<obj>)?)",
    "suf": r"(?:D|Q|<args>|p)",
    "un": r"(?:[XUp]|<args>(?=[insXUα-η0-7]))",
    "bin": r"(?:[BXlg=])",
    "seq": r"<un>*<prim><suf>*(?:<bin><un>*<prim><suf>*)*",
    "expr": r"<seq>(?:T(?:<seq>)?(?:T<seq>:<seq>)*:<seq>)*",
    "init": r"(?:<expr>|<obj>)",
    "vars": r"<ds><dtor>(?::<expr>)?(?:=<init>)?(?:,<dtor>(?:=<init>)?)*",
    "p1": r"(?:(?:<expr>|<ds>X*)(?:,(?:<expr>|<ds>X*))*)?", "p2": r"(?:<ds>(?:<dtor>|(?:X|M)*Q*)(?:,<ds>(?:<dtor>|(?:X|M)*Q*))*(?:,e)?)?",
    "p4": r"(?:<vars>|<expr>(?:,<expr>)*)?;(?:<expr>)?;(?:<expr>(?:,<expr>)*)?",
    "q": r"(?:M*<expr>)?",
    "b2": r"(?:(?:(?:(?:Q|D)+=)?<init>)(?:,(?:(?:Q|D)+=)?<init>)*,?)?|i(?:=<expr>)?(?:,i(?:=<expr>)?)*,?",
    "s2": r"(?:;|<blk>|I<args>|E|W<args>|f<head>|O|S<args><blk>|i:|C<expr>(?:e<expr>)?:|d:)",
    "s1": r"(?:<vars>|<expr>(?:,<expr>)*|R(?:<expr>)?|b|<ds>)",
    "b1": r"(?:(?><s2>)*+(?><s1>;))*+(?><s2>)*+",
    "b4": r"(?><vars>;|<ds>;|;)*+",
    "top": r"(?><ds>(?:X|M)*i(?:<params>)(?:i<args>)*<blk>|<vars>;|<ds>;|;|i<args>;?|Ms<blk>|Ms<body>)*+",
}

_GO = {
    "type": r"(?:[XQH]|e|iQ)*(?:iD?|q(?:<body>)|F<params>(?:iD?|<params>|[XQ]+iD?)?|<params>)Q?",
    "res": r"(?:<type>)?",
    "fun": r"F<params><res><blk>",
    "prim": r"(?:[ins]|<args>|<fun>|Q+<type><obj>?|iQ<type><obj>?|q<body><obj>|H<type>|X*q<body>)",
    "suf": r"(?:D|Q|<args>|<obj>|o<args>)",
    "un": r"(?:[XU]|rX)",
    "seq": r"<un>*<prim><suf>*(?:[BXlg]<un>*<prim><suf>*)*",
    "expr": "<seq>",
    "exprs": r"<expr>(?:,<expr>)*",
    "arg": r"(?:<expr>|<type>)",
    "p1": r"(?:<arg>(?:,<arg>)*(?:e)?,?)?", "p2": r"(?:(?:i(?:,i)*<type>|<type>)(?:,(?:i(?:,i)*<type>|<type>))*,?)?",
    "p4": r"(?:(?:(?:[ioX]?s)|i(?:,i)*(?:<type>)?(?:=<exprs>)?|i(?:Q)?=?<type>|o s|os);)*(?:(?:[io]?s)|i(?:,i)*(?:<type>)?(?:=<exprs>)?|i(?:Q)?=?<type>)?",
    "q": r"(?:<expr>|<type>|e)?(?::(?:<expr>)?){0,2}|i<type>(?:,i<type>)*",
    "kv": r"(?:(?:<expr>|<obj>):)?(?:<expr>|<obj>)",
    "b2": r"(?:<kv>(?:,<kv>)*,?;?)?",
    "simple": r"(?:<exprs>(?:=<exprs>)?|<expr>p|<exprs>=U<expr>)",
    "if": r"I(?:<simple>;)?<expr><blk>",
    "s1": r"(?:<simple>|v(?:i(?:,i)*(?:<type>)?(?:=<exprs>)?|<head>)|y(?:i(?:Q)?=?<type>|<head>)|R(?:<exprs>)?|bi?|<if>(?:E<if>)*(?:E<blk>)?"
    r"|f(?:<simple>?;<expr>?;<simple>?|<expr>|(?:<exprs>=)?U<expr>)?<blk>|S(?:(?:<simple>;)?(?:<exprs>(?:=<expr>)?)?)?<blk>|<blk>|i:)",
    "case": r"(?:C(?:<simple>|<type>(?:,(?:<type>|<expr>))*|<exprs>):|d:)",
    "b1": r"(?>;|<case>|i:)*+(?:(?><s1>;+)(?>;|<case>|i:)*+)*+(?:<s1>)?",
    "b4": r"(?:(?:i(?:,i)*<type>s?|X?iD?Q?s?|i<params><res>|(?:U?<type>)(?:B<type>)*);?)*",
    "fd": r"F(?:<params>)?iQ?<params><res><blk>?",
    "top": r";*ki;+(?:m(?:[io]?s|os|<head>);+)*(?:(?:<fd>|v(?:i(?:,i)*(?:<type>)?(?:=<exprs>)?|<head>)|y(?:i(?:Q)?=?<type>|<head>))(?:;+|\Z))*",
}

_RUST = {
    "at": r"(?:#U?Q)*", "path": r"(?:c?[in]G?(?:c(?:[in]G?|G))*|lg)",
    "type": r"(?:X+L?M*|X*M+(?=[XLMincQFα-η])|M*)*(?:<path>(?:<params>r<ret>|<args>(?:r<ret>)?)?(?:X(?:L|T?<path>(?:<args>)?(?:r<path>)?))*|Q|<args>|<params>|M*s?F<params>(?:r<ret>)?|U)",
    "ret": r"(?:X+L?M*|M+)*(?:<path>|Q|<args>|<params>|U)(?:X(?:L|<path>))*",
    "pat": r"(?:M|X)*(?:<path>(?:<args>|<obj>)?|<args>|Q|X?n|s|e)(?:e(?:X?n|s|i)?)?(?:B(?:M|X)*(?:<path>(?:<args>|<obj>)?|<args>|X?n|s)(?:e(?:n|s)?)?)*(?:@(?:<pat0>))?",
    "pat0": r"(?:X?[ins](?:e[ins]?)?|<args>)",
    "clo": r"M*(?:B(?:<pat>(?::<type>)?(?:,<pat>(?::<type>)?)*,?)?B|BB|b)(?:r<type>(?=[0-7]))?",
    "ifx": r"I(?:v<pat>=)?<seq0><blk>(?:EI(?:v<pat>=)?<seq0><blk>)*(?:E<blk>)?",
    "prim0": r"(?:s|n|<path>|<args>|Q|M*<blk>|i<obj>(?=D|T))",
    "seq0": r"(?:[XUMe]|B(?=i))*<prim0><suf>*(?:(?:[BXlg=e]|gg)(?:[XUMv])*(?:<pat>=)?<prim0><suf>*)*",
    "prim": r"(?:s|n|<path>(?:<obj>|<body>|<blk>)?|<args>|Q|M*<blk>|<ifx>|S<seq0><body>|(?:L:)?(?:O|W(?:v<pat>=)?<seq0>|f<pat>B<seq0>)<blk>|R|bL?)",
    "suf": r"(?:D(?:cG)?|Q|<args>|T|B<type>)",
    "un": r"(?:[XUMe]|<clo>|R|bL?)",
    "bin": r"(?:[BXlg=e]|gg|e=|gg=)",
    "seq": r"<un>*<prim><suf>*(?:<bin><un>*<prim><suf>*)*(?:e)?",
    "expr": r"(?:<seq>|e)",
    "p1": r"(?:<expr>(?:,<expr>)*,?)?|(?:<type>(?:,<type>)*,?)?|<pat>(?:,<pat>)*,?|i(?:=<expr>)?|<at>M*<args>?<type>(?:,M*<type>)*,?",
    "p2": r"(?:<at>(?:X?L?M*n|(?:M*<pat>:)?<type>|Mn:<type>)(?:,<at>(?:<pat>:<type>|<type>|e))*,?)?",
    "p4": r"[^!]*",
    "q": r"(?:<expr>(?:[,;]<expr>)*,?|<type>;<expr>|<type>|[^!]*)?",
    "b2": r"(?:<at>(?:[in]:<expr>|i|ee?<expr>|e|M*i|n:<expr>|i:<pat>)(?:,<at>(?:[in]:<expr>|i|e<expr>|e|M*i|i:<pat>))*,?)?",
    "use": r"M*<args>?mc?(?:[inM]c)*(?:[inM](?:Bi)?|<obj>|<body>|<blk>|X)",
    "whr": r"(?:w(?:<type>|L):(?:<type>|L)(?:X<type>)*(?:,<type>:<type>)*,?)?",
    "fd": r"(?:M|<args>)*s?F[iSn]?i?G?<params>(?:r<type>)?<whr>(?:<blk>|;)",
    "item": r"<at>(?:<use>;|<fd>|(?:M|<args>)*k[in]G?(?::<type>(?:X<type>)*)?<whr>(?:<body>|<blk>|<obj>|<params>?<args>?;)|M*KG?U?(?:<type>)(?:f<type>)?<whr>(?:<body>|<blk>)|(?:M|<args>)*(?:[in]):<type>(?:=<expr>)?;|M*<args>?y[in]G?(?::<type>)?(?:=<type>)?;|M+s?(?:<body>|<blk>)|i(?:<blk>|<obj>|<body>)|i[i]?(?:<body>|<obj>|<blk>)|i(?:Q|<args>);)",
    "s2": r"(?:;|<at>(?:M*<blk>|<ifx>|S<seq0><body>|(?:L:)?(?:O|W(?:v<pat>=)?<seq0>|f<pat>B<seq0>)<blk>)(?!D|T)|<item>)",
    "s1": r"<at>(?:v<pat>(?::<type>)?(?:=<expr>(?:E<blk>)?)?|<expr>)",
    "b1": r"(?:(?><s2>)*+(?><s1>;))*+(?><s2>)*+(?:<expr>)?",
    "arm": r"<at>B?<pat>(?:I<seq0>)?a",
    "fld": r"<at>(?:M|<args>)*[in]:<type>",
    "b4": r"(?><arm>(?:<blk>,?(?!D)|<expr>,))*+(?:<arm><expr>)?|(?:<fld>(?:,<fld>)*,?)?|(?:<at>i(?:<args>|<params>|<obj>|<body>)?(?:=<expr>)?(?:,<at>i(?:<args>|<params>|<obj>|<body>)?(?:=<expr>)?)*,?)?|(?><item>|;)*+|(?:[inX](?:ci)*(?:<obj>|<body>|Bi)?(?:c[iXn])*(?:c<obj>|c<body>)?(?:Bi)?)(?:,(?:[inX](?:c[iXn])*(?:c<obj>|c<body>)?(?:Bi)?))*,?",
    "top": r"(?><item>|;)*+",
}

_PY = {
    "line": "", "w": "[izq]",
    "lam": r"j(?:(?:X|B)*<w>?(?:=<seq>)?(?:,(?:X|B)*<w>?(?:=<seq>)?)*):",
    "prim": r"(?:[izqn]|s+|e|<args>|Q|<obj>)",
    "suf": r"(?:D|Q|<args>)",
    "un": r"(?:[XU~]|UU)",
    "bin": r"(?:[BXlg@]|g g|z|Uz|BU)",
    "seq": r"<un>*<prim><suf>*(?:<bin><un>*<prim><suf>*)*",
    "cond": r"<seq>(?:I<seq>E<seq>)*",
    "expr": r"(?:<lam>)*<cond>",
    "star": r"[XB]?<expr>",
    "tuple": r"<star>(?:,<star>)*,?",
    "comp": r"(?:M?f(?:X?<prim><suf>*)(?:,X?<prim><suf>*)*,?z<seq>(?:I<seq>)*)+",
    "arg": r"(?:[izq]=<expr>|<star>(?:<comp>)?)",
    "p1": r"(?:<arg>(?:,<arg>)*,?)?|U<tuple>?|Uq<expr>", "p2": r"(?:(?:[XB]?[izq](?::<expr>)?(?:=<expr>)?|X|B)(?:,(?:[XB]?[izq](?::[X]?<expr>)?(?:=<expr>)?|X|B))*,?)?",
    "p4": r"(?:<w>(?:w<w>)?(?:,<w>(?:w<w>)?)*,?)|<expr>(?:w<prim>)?(?:,<expr>(?:w<prim>)?)*,?",
    "q": r"(?:(?:<star>(?:<comp>)?)?(?::(?:<expr>)?){0,2}(?:,(?:<star>)?(?::(?:<expr>)?){0,2})*)?",
    "b1": "(?!)", "b4": "(?!)",
    "b2": r"(?:<star>(?::<expr>)?(?:<comp>)?(?:,<star>(?::<expr>)?)*,?)?",
    "tgt": r"(?:X?<prim><suf>*)(?:,X?<prim><suf>*)*,?",
    "simple": r"(?:<tuple>(?::<expr>)?(?:=(?:U?q?<tuple>|U<tuple>?))*|R(?:<tuple>)?(?:q<expr>)?|b|d<tuple>|V[izq](?:,[izq])*|U<tuple>?|Uq<expr>|m[izq]D*(?:w[izq])?(?:,[izq]D*(?:w[izq])?)*|qo*(?:e|[izq])?D*m(?:X|[izq](?:w[izq])?(?:,[izq](?:w[izq])?)*|<head>))",
    "head0": r"(?:M?F[izq]Q?<params>(?:r<expr>)?|K[izq]Q?<args>?|[ILW](?:i=)?<expr>|E|t|hX?(?:<expr>(?:,<expr>)*(?:w[izq])?)?|y|M?f<tgt>z<tuple>|M?Y(?:<head>|<args>|<expr>(?:w<prim><suf>*)?(?:,<expr>(?:w<prim><suf>*)?)*)|i<tuple>)",
    "dec": r"@<expr>",
    "top": r"(?><simple>;|<head0>:(?:;→(?=[^←])|(?=[^;→←]))|<dec>;|←|;)*+",
}

RULES = {"javascript": _JS, "typescript": _TS, "java": _JAVA, "csharp": _CSHARP, "c": _C, "go": _GO, "rust": _RUST, "python": _PY}


@lru_cache(None)
def expanded(language: str, rule: str) -> str:
    """The regular expression of a rule."""
    rules = _SHARED | RULES[language]
    text = rules[rule].replace(" ", "")
    return re.sub(r"<(\w+)>", lambda m: f"(?:{expanded(language, m[1])})", text)


class Reducer:
    """Reduces class strings of one language; contents once seen are remembered."""

    KEEP = 200_000

    def __init__(self, language: str):
        self.language = language
        rule = lambda k: re.compile(expanded(language, k))
        self.brace = [(k, rule(f"b{k}")) for k in (1, 2, 4)]
        self.paren = [(k, rule(f"p{k}")) for k in (1, 2, 4)]
        self.bracket, self.top = rule("q"), rule("top")
        self.known: dict[str, str] = {}
        self.inner = re.compile(r"[(\[{][^()\[\]{}]*[)\]}]")
        self.generic = re.compile(r"(?<=[iFKkLYyDczS])l[iD,TxXQGncMLsBe:=α-ηr]*g|(?<=c)l[iD,TxXQGncML]*g") if language in ("typescript", "java", "csharp", "rust") else None
        if language == "typescript":
            self.generic = re.compile(r"(?<=[iFKLYDzU])l[iD,TxXQGnsBMUz=2-7α-ηa:]*g(?=[α-η(){},;:=\[\]BXgaD0-7xsUQ>]|\Z)")
        elif language == "rust":
            self.generic = re.compile(r"(?<=[icKFykn])l[iD,TxXQGncMLBe:=α-ηrU]*g|(?<=K)l[^g]*g")
        elif language == "java":
            self.generic = re.compile(r"(?<=[iDMcNA])l[iD,TxXQGAnB]*g|(?<=M)l[iD,TxXQGA]*g|^l[iDxX,QG]*g(?=i)")

    def _angles(self, s: str) -> str:
        if self.generic is not None and "l" in s:
            while True:
                t = self.generic.sub("G", s)
                if t == s:
                    return t
                s = t
        return s

    def _group(self, m: re.Match) -> str:
        s = m[0]
        if (got := self.known.get(s)) is None:
            if len(self.known) >= self.KEEP:
                self.known.clear()
            got = self.known[s] = self._fit(s)
        return got

    def _fit(self, s: str) -> str:
        kind, body = s[0] + s[-1], s[1:-1]
        if kind not in ("()", "[]", "{}") or "!" in body:
            return "!"
        if self.language == "python":
            body = body.replace(";", "")
        body = self._angles(body)
        if kind == "[]":
            return "Q" if self.bracket.fullmatch(body) else "!"
        base, rules = (BRACE, self.brace) if kind == "{}" else (PAREN, self.paren)
        mask = sum(k for k, r in rules if r.fullmatch(body))
        return chr(ord(base) + mask) if mask else "!"

    def valid(self, s: str) -> bool:
        """Whether the nesting closes and every group and the whole fit a production."""
        while True:
            if "!" in s:
                return False
            t, n = self.inner.subn(self._group, s)
            if not n:
                break
            s = t
        if any(c in s for c in "()[]{}!"):
            return False
        if (got := self.known.get("\0" + s)) is None:
            got = "1" if self.top.fullmatch(self._angles(s)) else ""
            if len(s) < 80:
                self.known["\0" + s] = got
        return bool(got)


_ANY = "any"
_INNER = "iD,TxXncMLsBe:=Uzar()[]{}AdNKjFRwkYqJl"  # what may stand in type arguments


class _Shape:
    """nullable, first and last symbols, and adjacent pairs of what a rule matches."""

    def __init__(self, nullable: bool = True, first: frozenset = frozenset(), last: frozenset = frozenset(), pairs: frozenset = frozenset()):
        self.nullable, self.first, self.last, self.pairs = nullable, first, last, pairs

    def then(self, o: _Shape) -> _Shape:
        across = frozenset((a, b) for a in self.last for b in o.first)
        return _Shape(
            self.nullable and o.nullable, self.first | (o.first if self.nullable else frozenset()),
            o.last | (self.last if o.nullable else frozenset()), self.pairs | o.pairs | across,
        )

    def either(self, o: _Shape) -> _Shape:
        return _Shape(self.nullable or o.nullable, self.first | o.first, self.last | o.last, self.pairs | o.pairs)

    def times(self, mark: str) -> _Shape:
        again = frozenset((a, b) for a in self.last for b in self.first) if mark != "?" else frozenset()
        return _Shape(self.nullable or mark != "+", self.first, self.last, self.pairs | again)


class _Shapes:
    """Shapes of the rules of one language, from their text without expanding it."""

    def __init__(self, language: str):
        self.rules = _SHARED | RULES[language]
        self.made: dict[str, _Shape] = {}

    def of(self, rule: str) -> _Shape:
        if rule not in self.made:
            self.text, keep = self.rules[rule].replace(" ", ""), (getattr(self, "text", ""), getattr(self, "at", 0))
            self.at = 0
            self.made[rule] = self._choice()
            self.text, self.at = keep
        return self.made[rule]

    def _choice(self) -> _Shape:
        out = self._run()
        while self.text[self.at : self.at + 1] == "|":
            self.at += 1
            out = out.either(self._run())
        return out

    def _run(self) -> _Shape:
        out = _Shape()
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            one = self._one()
            if m := re.compile(r"(?:[*+?]|\{\d+,\d*\})\+?").match(self.text, self.at):
                self.at = m.end()
                one = one.times("*" if m[0][0] == "{" else m[0][0])
            out = out.then(one)
        return out

    def _one(self) -> _Shape:
        t, at = self.text, self.at
        if m := re.compile(r"\(\?(?:<?[=!])").match(t, at):
            depth = 0
            while True:
                depth += {"(": 1, ")": -1}.get(t[self.at], 0)
                self.at += 1
                if not depth:
                    return _Shape() if m[0] != "(?!" or t[at : self.at] != "(?!)" else _Shape(False)
        if m := re.compile(r"\(\?[:>]").match(t, at):
            self.at = m.end()
            out = self._choice()
            self.at += 1
            return out
        if m := re.compile(r"<(\w+)>").match(t, at):
            self.at = m.end()
            return self.of(m[1])
        if m := re.compile(r"\[(\^?)([^\]]+)\]").match(t, at):
            self.at = m.end()
            chars = re.sub(r"(.)-(.)", lambda r: "".join(map(chr, range(ord(r[1]), ord(r[2]) + 1))), m[2])
            symbols = frozenset([_ANY]) if m[1] else frozenset(chars)
            out = _Shape(False, symbols, symbols)
            return out.times("+") if m[1] else out
        if t[at : at + 2] == "\\Z":
            self.at += 2
            return _Shape()
        self.at += 1
        return _Shape(False, frozenset(t[at]), frozenset(t[at]))


def _ends(symbol: str) -> tuple[str, str]:
    """First and last token of a symbol."""
    if BRACE <= symbol <= "7" and len(symbol) == 1:
        return "{", "}"
    if "\u03b0" <= symbol <= "\u03b8":
        return "(", ")"
    return {"Q": ("[", "]"), "G": ("l", "g")}.get(symbol, (symbol, symbol))


@lru_cache(None)
def pairs(language: str) -> frozenset[str]:
    """Every pair of adjacent token classes that the grammar permits; ^ and $ stand for the ends of a file."""
    shapes = _Shapes(language)
    every = {k for rules in (_SHARED, RULES[language]) for k in rules}
    alphabet = set(WORDS[language]) | set("insDXBUplgacreTA=,;:@#Loz()[]{}QGw\u2190\u2192")
    out: set[tuple[str, str]] = set()
    for rule in ["top", "b1", "b2", "b4", "p1", "p2", "p4", "q"]:
        s = shapes.of(rule)
        opening, closing = {"t": ("^", "$"), "b": ("{", "}"), "p": ("(", ")"), "q": ("[", "]")}[rule[0]]
        got = set(s.pairs) | {(opening, b) for b in s.first} | {(a, closing) for a in s.last} | ({(opening, closing)} if s.nullable else set())
        for a, b in got:
            for x in alphabet if a == _ANY else [a]:
                for y in alphabet if b == _ANY else [b]:
                    out.add((_ends(x)[1], _ends(y)[0]))
    if language in ("typescript", "java", "csharp", "rust"):
        out |= {(a, b) for a in _INNER for b in _INNER} | {("l", b) for b in _INNER} | {(a, "g") for a in _INNER} | {("g", "g"), ("g", "l"), ("g", "D"), ("g", ","), ("g", "]"), ("g", "[")}
    assert every
    return frozenset(a + b for a, b in out)


assert set(RULES) == set(WORDS)
