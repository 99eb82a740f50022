"""License scans: ordered signature rules behind a keyword prefilter; priority and containment settle overlapping detections."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import extended, mapped, slices, without

# Phrases of the base rules, as words, and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Identifiers of the SPDX list and their labels.
SPDX = """
MIT mit, MIT-0 mit-0, ISC isc, 0BSD 0bsd, X11 x11, HPND hpnd, BSD-2-Clause bsd-2-clause, BSD-3-Clause bsd-3-clause, BSD-4-Clause bsd-4-clause, BSD-3-Clause-Clear bsd-3-clause-clear,
Apache-1.0 apache-1, Apache-1.1 apache-1.1, Apache-2.0 apache-2, GPL-1.0-only gpl-1, GPL-1.0-or-later gpl-1+, GPL-2.0 gpl-2, GPL-2.0-only gpl-2, GPL-2.0-or-later gpl-2+, GPL-3.0 gpl-3,
GPL-3.0-only gpl-3, GPL-3.0-or-later gpl-3+, LGPL-2.0-only lgpl-2, LGPL-2.0-or-later lgpl-2+, LGPL-2.1 lgpl-2.1, LGPL-2.1-only lgpl-2.1, LGPL-2.1-or-later lgpl-2.1+, LGPL-3.0 lgpl-3,
LGPL-3.0-only lgpl-3, LGPL-3.0-or-later lgpl-3+, AGPL-3.0 agpl-3, AGPL-3.0-only agpl-3, AGPL-3.0-or-later agpl-3+, MPL-1.0 mpl-1, MPL-1.1 mpl-1.1, MPL-2.0 mpl-2, EPL-1.0 epl-1, EPL-2.0 epl-2,
CDDL-1.0 cddl-1, CDDL-1.1 cddl-1.1, EUPL-1.1 eupl-1.1, EUPL-1.2 eupl-1.2, CPL-1.0 cpl-1, OSL-3.0 osl-3, CECILL-2.1 cecill-2.1, Artistic-1.0 artistic-1, Artistic-2.0 artistic-2, BSL-1.0 bsl-1, Zlib zlib,
Libpng libpng, Unlicense unlicense, WTFPL wtfpl, PSF-2.0 psf-2, Python-2.0 python-2, PHP-3.0 php-3, PHP-3.01 php-3.01, Ruby ruby, OpenSSL openssl, PostgreSQL postgresql, NCSA ncsa, MS-PL ms-pl,
MS-RL ms-rl, W3C w3c, Beerware beerware, JSON json, curl curl, IJG ijg, OFL-1.0 ofl-1, OFL-1.1 ofl-1.1, UPL-1.0 upl-1, BUSL-1.1 busl-1.1, SSPL-1.0 sspl-1, Elastic-2.0 elastic-2, CC0-1.0 cc0-1,
CC-BY-3.0 cc-by-3, CC-BY-4.0 cc-by-4, CC-BY-SA-3.0 cc-by-sa-3, CC-BY-SA-4.0 cc-by-sa-4, CC-BY-ND-4.0 cc-by-nd-4, CC-BY-NC-3.0 cc-by-nc-3, CC-BY-NC-4.0 cc-by-nc-4, CC-BY-NC-SA-4.0 cc-by-nc-sa-4,
CC-BY-NC-ND-4.0 cc-by-nc-nd-4, ODbL-1.0 odbl-1, ODC-By-1.0 odc-by-1, PDDL-1.0 pddl-1, GFDL-1.2-or-later gfdl-1.2+, GFDL-1.3-only gfdl-1.3, GFDL-1.3-or-later gfdl-1.3+
"""
# Ordered rules, a line each: label, priority (3: a text's own words; 2: a title with its version or one of its own; 1: a bare title), keywords of which a
# match holds one, pattern over words. {L}, {S}, {V} and {LATER} are those of PARTS; a version found by {V} goes into the label.
RULES = r"""
# ---- MIT and its kin
mit 2 mit: (?:the )?mit {L}
mit 2 mit: (?:the )?mit x11 {L}
mit 2 mit: mit style {L}
mit 2 expat: (?:the )?expat(?: mit)? {L}
mit 1 x11: x11 {L}
mit 3 hereby: permission is hereby granted free of charge to any person obtaining a copy of this (?:software|work|font)
mit 3 merchantability: (?:the software is )?provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit 3 substantial: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit 2 opensource: opensource org licenses mit(?: license)?(?: php)?
mit-0 2 attribution: mit no attribution(?: {L})?
isc 2 isc: (?:the )?isc {L}
isc 2 consortium: internet (?:systems|software) consortium {L}
isc 3 fee: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0bsd 2 0bsd: 0bsd(?: {L})?
0bsd 2 zero: (?:bsd zero clause|zero clause bsd) {L}
hpnd 3 fee: permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
# ---- BSD
bsd 1 bsd: (?:the )?bsd {L}
bsd 1 bsd: bsd style {L}
bsd-2-clause 2 bsd: (?:2|two) clause bsd(?: {L})?
bsd-2-clause 2 bsd: bsd (?:2|two) clause(?: {L})?
bsd-2-clause 2 bsd: simplified bsd {L}
bsd-2-clause 2 freebsd: (?:the )?freebsd {L}
bsd-3-clause 2 bsd: (?:3|three) clause bsd(?: {L})?
bsd-3-clause 2 bsd: bsd (?:3|three) clause(?: {L})?
bsd-3-clause 2 bsd: (?:new|modified|revised) bsd {L}
bsd-4-clause 2 bsd: (?:4|four) clause bsd(?: {L})?
bsd-4-clause 2 bsd: bsd (?:4|four) clause(?: {L})?
bsd-4-clause 2 bsd: (?:original|old) bsd {L}
bsd 3 redistribution: redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd 3 redistributions: redistributions of source code must retain the above copyright notice
bsd-3-clause 3 endorse: neither the names? of (?:\S+ ){1,12}nor the names of (?:its|their|any) contributors may be used to endorse
bsd-4-clause 3 advertising: all advertising materials mentioning features or use of this software must display
bsd-2-clause 2 opensource: opensource org licenses bsd 2 clause
bsd-3-clause 2 opensource: opensource org licenses bsd 3 clause
# ---- Apache
apache 1 apache: (?:the )?apache(?: software)? {L}
apache-1 2 apache: (?:the )?apache(?: software)? {L}{S}1(?: 0)?
apache-1.1 2 apache: (?:the )?apache(?: software)? {L}{S}1 1
apache-2 2 apache: (?:the )?apache(?: software)? {L}{S}2(?: 0)?
apache-2 2 apache: apache 2(?: 0)?(?: {L}| licensed)?
apache-2 2 asl: asl(?: v| )?2(?: 0)?
apache-2 2 asl2: asl2
apache-2 3 compliance: you may not use this file except in compliance with the license
apache-2 2 apache: (?:www )?apache org licenses license 2 0(?: txt| html)?
apache-1 2 apache: (?:www )?apache org licenses license 1 0(?: txt| html)?
apache-1.1 2 apache: (?:www )?apache org licenses license 1 1(?: txt| html)?
# ---- GPL
gpl 1 public: (?:the )?gnu general public {L}
gpl 1 gpl: (?:the )?(?:gnu )?gpl(?: {L})?
gpl-1 2 public: (?:the )?gnu general public {L}{S}1(?: 0)?
gpl-1+ 2 public: (?:the )?gnu general public {L}{S}1(?: 0)?{LATER}
gpl-2 2 public: (?:the )?gnu general public {L}{S}2(?: 0)?(?: only)?
gpl-2+ 2 public: (?:the )?gnu general public {L}{S}2(?: 0)?{LATER}
gpl-3 2 public: (?:the )?gnu general public {L}{S}3(?: 0)?(?: only)?
gpl-3+ 2 public: (?:the )?gnu general public {L}{S}3(?: 0)?{LATER}
gpl-1 2 gpl: (?:the )?(?:gnu )?gpl{S}1(?: 0)?
gpl-2 2 gpl: (?:the )?(?:gnu )?gpl{S}2(?: 0)?(?: only| {L})?
gpl-2+ 2 gpl: (?:the )?(?:gnu )?gpl{S}2(?: 0)?{LATER}
gpl-3 2 gpl: (?:the )?(?:gnu )?gpl{S}3(?: 0)?(?: only| {L})?
gpl-3+ 2 gpl: (?:the )?(?:gnu )?gpl{S}3(?: 0)?{LATER}
gpl-2 2 gplv2,gpl2: (?:the )?(?:gnu )?gplv?2(?: 0)?(?: only| {L})?
gpl-2+ 2 gplv2,gpl2: (?:the )?(?:gnu )?gplv?2(?: 0)?{LATER}
gpl-3 2 gplv3,gpl3: (?:the )?(?:gnu )?gplv?3(?: 0)?(?: only| {L})?
gpl-3+ 2 gplv3,gpl3: (?:the )?(?:gnu )?gplv?3(?: 0)?{LATER}
gpl-2+ 3 redistribute: this (?:program|software|file|code) is free software you can redistribute it and or modify it under the terms of the gnu general public {L} as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3+ 3 redistribute: this (?:program|software|file|code) is free software you can redistribute it and or modify it under the terms of the gnu general public {L} as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2 3 redistribute: this (?:program|software|file|code) is free software you can redistribute it and or modify it under the terms of the gnu general public {L} version 2(?: only)? as published by the free software foundation
gpl-3 3 redistribute: this (?:program|software|file|code) is free software you can redistribute it and or modify it under the terms of the gnu general public {L} version 3(?: only)? as published by the free software foundation
gpl 3 redistribute: this (?:program|software|file|code) is free software you can redistribute it and or modify it under the terms
gpl-2+ 3 either: either version 2 of the license or at your option any later version
gpl-3+ 3 either: either version 3 of the license or at your option any later version
gpl 3 received: you should have received a copy of the gnu general public {L}
gpl 2 gnu: (?:www )?gnu org (?:licenses|copyleft) gpl(?: html| txt)?
gpl-2 2 gnu: (?:www )?gnu org licenses old licenses gpl 2 0
gpl-3 2 gnu: (?:www )?gnu org licenses gpl 3 0
gpl-2-classpath 2 classpath: (?:gpl(?: v?2| 2 0)? with (?:the )?)?classpath exception
gpl-2-linking 3 linking: as a special exception (?:\S+ ){0,12}linking
# ---- LGPL
lgpl 1 lesser: (?:the )?gnu lesser general public {L}
lgpl 1 library: (?:the )?gnu library general public {L}
lgpl 1 lgpl: (?:the )?(?:gnu )?lgpl(?: {L})?
lgpl-2 2 library: (?:the )?gnu library general public {L}{S}2(?: 0)?
lgpl-2+ 2 library: (?:the )?gnu library general public {L}{S}2(?: 0)?{LATER}
lgpl-2.1 2 lesser: (?:the )?gnu lesser general public {L}{S}2 1(?: only)?
lgpl-2.1+ 2 lesser: (?:the )?gnu lesser general public {L}{S}2 1{LATER}
lgpl-3 2 lesser: (?:the )?gnu lesser general public {L}{S}3(?: 0)?(?: only)?
lgpl-3+ 2 lesser: (?:the )?gnu lesser general public {L}{S}3(?: 0)?{LATER}
lgpl-2 2 lgpl: (?:the )?(?:gnu )?lgpl{S}2(?: 0)?
lgpl-2+ 2 lgpl: (?:the )?(?:gnu )?lgpl{S}2(?: 0)?{LATER}
lgpl-2.1 2 lgpl: (?:the )?(?:gnu )?lgpl{S}2 1(?: only| {L})?
lgpl-2.1+ 2 lgpl: (?:the )?(?:gnu )?lgpl{S}2 1{LATER}
lgpl-3 2 lgpl: (?:the )?(?:gnu )?lgpl{S}3(?: 0)?(?: only| {L})?
lgpl-3+ 2 lgpl: (?:the )?(?:gnu )?lgpl{S}3(?: 0)?{LATER}
lgpl-2.1 2 lgplv2: (?:the )?(?:gnu )?lgplv2 1
lgpl-2.1+ 2 lgplv2: (?:the )?(?:gnu )?lgplv2 1{LATER}
lgpl-3 2 lgplv3: (?:the )?(?:gnu )?lgplv3
lgpl-3+ 2 lgplv3: (?:the )?(?:gnu )?lgplv3{LATER}
lgpl-2.1+ 3 either: either version 2 1 of the license or at your option any later version
lgpl 3 redistribute: this library is free software you can redistribute it and or modify it under the terms
lgpl 3 received: you should have received a copy of the gnu (?:lesser|library) general public {L}
lgpl 2 gnu: (?:www )?gnu org (?:licenses|copyleft) lgpl(?: html| txt)?
# ---- AGPL
agpl 1 affero: (?:the )?(?:gnu )?affero general public {L}
agpl 1 agpl: (?:the )?(?:gnu )?agpl(?: {L})?
agpl-1 2 affero: (?:the )?affero general public {L}{S}1(?: 0)?
agpl-3 2 affero: (?:the )?(?:gnu )?affero general public {L}{S}3(?: 0)?(?: only)?
agpl-3+ 2 affero: (?:the )?(?:gnu )?affero general public {L}{S}3(?: 0)?{LATER}
agpl-3 2 agpl: (?:the )?(?:gnu )?agpl{S}3(?: 0)?(?: only| {L})?
agpl-3+ 2 agpl: (?:the )?(?:gnu )?agpl{S}3(?: 0)?{LATER}
agpl-3 2 agplv3: (?:the )?(?:gnu )?agplv3
agpl-3+ 2 agplv3: (?:the )?(?:gnu )?agplv3{LATER}
agpl 2 gnu: (?:www )?gnu org licenses agpl(?: html| txt)?
# ---- other copyleft and weak copyleft
mpl 1 mozilla: (?:the )?mozilla public {L}
mpl-1 2 mozilla: (?:the )?mozilla public {L}{S}1(?: 0)?
mpl-1.1 2 mozilla: (?:the )?mozilla public {L}{S}1 1
mpl-2 2 mozilla: (?:the )?mozilla public {L}{S}2(?: 0)?
mpl-1.1 2 mpl: mpl{S}1 1
mpl-2 2 mpl: mpl{S}2(?: 0)?
mpl-2 3 subject: this source code form is subject to the terms of the mozilla public {L} v 2 0
mpl-2 2 mozilla: (?:www )?mozilla org mpl 2 0
mpl-1.1 2 mozilla: (?:www )?mozilla org mpl mpl 1 1
epl 1 eclipse: (?:the )?eclipse public {L}
epl-1 2 eclipse: (?:the )?eclipse public {L}{S}1(?: 0)?
epl-2 2 eclipse: (?:the )?eclipse public {L}{S}2(?: 0)?
epl-1 2 eclipse: (?:www )?eclipse org legal epl v10
epl-2 2 eclipse: (?:www )?eclipse org legal epl 2 0
edl-1 2 eclipse: eclipse distribution {L}(?:{S}1(?: 0)?)?
cddl 1 development: common development and distribution {L}
cddl-1 2 development: common development and distribution {L}{S}1(?: 0)?
cddl-1.1 2 development: common development and distribution {L}{S}1 1
cddl-1 2 cddl: cddl{S}1(?: 0)?
cddl-1.1 2 cddl: cddl{S}1 1
eupl 1 union: european union public {L}
eupl-1.1 2 union: european union public {L}{S}1 1
eupl-1.2 2 union: european union public {L}{S}1 2
eupl-1.2 2 eupl: eupl{S}1 2
cpl-1 2 common: common public {L}(?:{S}1(?: 0)?)?
ipl-1 2 ibm: ibm public {L}(?:{S}1(?: 0)?)?
osl-3 2 open: open software {L}(?:{S}3(?: 0)?)?
cecill 1 cecill: cecill(?: {L})?
cecill-2.1 2 cecill: cecill{S}2 1
artistic 1 artistic: (?:the )?(?:perl |clarified )?artistic {L}
artistic-1 2 artistic: (?:the )?(?:perl |clarified )?artistic {L}{S}1(?: 0)?
artistic-2 2 artistic: (?:the )?artistic {L}{S}2(?: 0)?
perl 3 perl: (?:under )?the same terms as perl itself
# ---- other permissive
bsl-1 2 boost: (?:the )?boost software {L}(?:{S}1(?: 0)?)?
zlib 2 zlib: (?:the )?zlib(?: libpng)? {L}
libpng 2 libpng: (?:the )?libpng {L}
zlib 3 misrepresented: the origin of this software must not be misrepresented
zlib 3 liable: this software is provided as is without any express or implied warranty in no event will the authors be held liable
unlicense 2 unlicense: (?:the )?unlicense
unlicense 3 unencumbered: this is free and unencumbered software released into the public domain
wtfpl 2 wtfpl: (?:the )?wtfpl(?:{S}2(?: 0)?)?
wtfpl 2 fuck: do what the fuck you want to public {L}
psf-2 2 python: python software foundation {L}(?:{S}2(?: 0)?)?
psf-2 1 psf: psf {L}(?:{S}2(?: 0)?)?
php-3 2 php: (?:the )?php {L}(?:{S}3(?: 0)?)?
php-3.01 2 php: (?:the )?php {L}{S}3 01
ruby 1 ruby: (?:the )?ruby {L}
openssl 2 openssl: (?:the )?openssl {L}
openssl 3 openssl: this product includes software developed by the openssl project
postgresql 2 postgresql: (?:the )?postgresql {L}
ncsa 2 ncsa: (?:university of illinois )?ncsa open source {L}
ms-pl 2 microsoft: microsoft public {L}
ms-rl 2 microsoft: microsoft reciprocal {L}
w3c 2 w3c: (?:the )?w3c software(?: notice and)? {L}
beerware 2 beer: (?:the )?beer ?ware {L}
beerware 2 beerware: (?:the )?beerware {L}
json 3 evil: the software shall be used for good not evil
curl 2 curl: (?:the )?curl {L}
ijg 2 jpeg: independent jpeg group(?: s software| {L})
ofl-1.1 2 ofl: (?:the )?(?:sil )?ofl(?:{S}1 1)?
ofl-1.1 2 font: (?:the )?(?:sil )?open font {L}(?:{S}1 1)?
ofl-1 2 font: (?:the )?(?:sil )?open font {L}{S}1 0
upl-1 2 universal: universal permissive {L}(?:{S}1(?: 0)?)?
# ---- source available and closed
busl-1.1 2 business: business source {L}(?:{S}1 1)?
sspl-1 2 server: server side public {L}(?:{S}1(?: 0)?)?
elastic-2 2 elastic: elastic {L}(?:{S}2(?: 0)?)?
commons-clause 2 clause: commons clause(?: {L})?(?: condition)?
polyform 2 polyform: polyform (?:noncommercial|small business|strict|shield|perimeter|free trial|internal use)(?: {L})?
all-rights-reserved 1 reserved: all rights (?:are )?reserved
all-rights-reserved 2 reproduced: (?:may not be|no part of this \S+ may be) (?:reproduced|copied|distributed)
proprietary 2 confidential: proprietary and confidential
proprietary 2 confidential: confidential and proprietary
proprietary 2 unauthorized: unauthorized copying of this file via any medium is strictly prohibited
non-commercial 2 use: for non ?commercial use only
research-only 2 research: for (?:academic|research)(?: and (?:academic|research|educational))? (?:use|purposes) only
copyright 1 copyright: copyright (?:c |© )?(?:19|20)\d\d
# ---- Creative Commons and data
cc-by 2 cc: cc by(?: {L})?(?:{S}{V})?
cc-by-sa 2 cc: cc by sa(?: {L})?(?:{S}{V})?
cc-by-nd 2 cc: cc by nd(?: {L})?(?:{S}{V})?
cc-by-nc 2 cc: cc by nc(?: {L})?(?:{S}{V})?
cc-by-nc-sa 2 cc: cc by nc sa(?: {L})?(?:{S}{V})?
cc-by-nc-nd 2 cc: cc by nc nd(?: {L})?(?:{S}{V})?
cc-by 1 creative: creative commons attribution(?:{S}{V})?(?: (?:international|unported|generic))?(?: {L})?
cc-by-sa 2 creative: creative commons attribution share ?alike(?:{S}{V})?(?: (?:international|unported|generic))?(?: {L})?
cc-by-nd 2 creative: creative commons attribution no ?deriv(?:ative)?s?(?:{S}{V})?(?: (?:international|unported|generic))?(?: {L})?
cc-by-nc 2 creative: creative commons attribution non ?commercial(?:{S}{V})?(?: (?:international|unported|generic))?(?: {L})?
cc-by-nc-sa 2 creative: creative commons attribution non ?commercial share ?alike(?:{S}{V})?(?: (?:international|unported|generic))?(?: {L})?
cc-by-nc-nd 2 creative: creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?:{S}{V})?(?: (?:international|unported|generic))?(?: {L})?
cc-by 2 creativecommons: creativecommons org licenses by(?: {V})?
cc-by-sa 2 creativecommons: creativecommons org licenses by sa(?: {V})?
cc-by-nd 2 creativecommons: creativecommons org licenses by nd(?: {V})?
cc-by-nc 2 creativecommons: creativecommons org licenses by nc(?: {V})?
cc-by-nc-sa 2 creativecommons: creativecommons org licenses by nc sa(?: {V})?
cc-by-nc-nd 2 creativecommons: creativecommons org licenses by nc nd(?: {V})?
public-domain 1 domain: public domain
public-domain 2 domain: (?:released|dedicated|placed|is) (?:in|into|to) the public domain
cc0-1 2 cc0: cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?
cc0-1 2 creative: creative commons (?:zero|cc0)(?: 1 0)?
cc0-1 2 creativecommons: creativecommons org publicdomain zero(?: 1 0)?
cc-pdm-1 2 creativecommons: creativecommons org publicdomain mark(?: 1 0)?
odbl-1 2 database: open (?:data commons open )?database {L}(?:{S}1(?: 0)?)?
odbl-1 2 odbl: odbl(?:{S}1(?: 0)?)?
odc-by-1 2 commons: open data commons attribution {L}(?:{S}1(?: 0)?)?
pddl-1 2 dedication: public domain dedication and {L}(?:{S}1(?: 0)?)?
cdla-permissive 2 community: community data {L} agreement permissive
cdla-sharing 2 community: community data {L} agreement sharing
gfdl 1 documentation: gnu free documentation {L}
gfdl-1.2 2 documentation: gnu free documentation {L}{S}1 2
gfdl-1.2+ 2 documentation: gnu free documentation {L}{S}1 2{LATER}
gfdl-1.3 2 documentation: gnu free documentation {L}{S}1 3
gfdl-1.3+ 2 documentation: gnu free documentation {L}{S}1 3{LATER}
ogl-uk-3 2 government: open government {L}(?:{S}3(?: 0)?)?
"""
# Short names beside the identifiers, and their labels.
SHORT = """
Apache apache, Apache-2 apache-2, Apache2 apache-2, ASL-2.0 apache-2, BSD bsd, BSD-3 bsd-3-clause, BSD-2 bsd-2-clause, GPL gpl, GPL-2 gpl-2, GPL-3 gpl-3, GPLv2 gpl-2, GPLv3 gpl-3, GPL-v2 gpl-2, GPL-v3 gpl-3,
LGPL lgpl, LGPL-3 lgpl-3, LGPLv3 lgpl-3, AGPL agpl, AGPL-3 agpl-3, AGPLv3 agpl-3, MPL mpl, MPL-2 mpl-2, MPLv2 mpl-2, EPL epl, EPL-2 epl-2, CC0 cc0-1, CC-BY cc-by, CC-BY-SA cc-by-sa, public-domain public-domain
"""
#: Families whose short names are no common words; others name a license only after words that say so.
FAMILIES = ("mit", "bsd", "0bsd", "apache", "gpl", "lgpl", "agpl", "mpl", "epl", "cddl", "eupl", "cc", "cc0", "bsl", "isc", "unlicense")
PARTS = {
    "{LATER}": r"(?: and)?(?: or)?(?: at your option)?(?: any)? (?:later|newer)(?: versions?)?",
    "{L}": r"licen[sc]es?",
    "{S}": r"(?: version | ver | v ?| )",
    "{V}": r"(?P<v>1 0|2 0|2 5|3 0|4 0)",
}
#: What may stand before a title and makes it a grant.
_GRANT = re.compile(r"(?<![^ ])(?:(?:dual |double )?(?:licen[sc]ed|released|distributed|available|provided|published|covered|offered) )?(?:under|with|by|subject to) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?$")
#: Characters of the longest words of a grant: no search for them need go back further.
_GRANT_CHARS = len(" double distributed subject to the terms and conditions of the ")
#: What may stand before a title and says that it doesn't hold, and what may stand after one that is no license.
_DENIED = re.compile(r"(?<![^ ])(?:not|no longer|never|nor|neither|isn t|aren t|other than|instead of)(?: (?:licen[sc]ed|released|distributed|available|provided|published|covered|offered))? (?:an? |the )?$")
_DENIED_CHARS = len(" no longer distributed the ")
_OTHER_THING = re.compile(r" (?:offices?|plates?|keys?|fees?|servers?|numbers?|holders?)(?![^ ])")
IDENTIFIER, GRANT, TITLE = 4, 3, 2


@dataclass(frozen=True)
class Rule:
    """pattern runs over ' '-joined lower-case words, where one of `keywords` must occur; priority decides among overlapping matches of which none holds the other. A rule without a label finds alternatives:
    each short name of its match gives that name's label, the first with the words before it."""

    pattern: re.Pattern
    keywords: tuple[str, ...]
    label: str
    priority: int
    order: int


@cache
def names() -> dict[str, str]:
    """Identifiers and short names, as words, with their labels."""
    pairs = (pair.split() for part in (SPDX, SHORT) for pair in part.replace("\n", " ").split(","))
    return {re.sub("[-.+]", " ", name.lower()).strip(): label for name, label in pairs}


def _chain(chosen: Iterable[str], least: int) -> str:
    one = rf"(?:{'|'.join(sorted(chosen, key=lambda n: (-len(n), n)))})(?: licen[sc]es?)?(?![^ ])"
    return rf"{one}(?:(?: or| and| and or)? {one}){{{least - 1},}}"


@cache
def _members() -> re.Pattern:
    return re.compile(rf"(?<![^ ])(?P<name>{'|'.join(sorted(names(), key=lambda n: (-len(n), n)))})(?: licen[sc]es?)?(?![^ ])")


def _alternatives() -> Iterator[tuple[str, str, int]]:
    """(pattern, keywords, priority) of the rules of alternatives: 'X or Y', 'X and Y', 'X/Y' and single names after words that announce a license; two names or more of plain families without such words."""
    every = _chain(names(), 1)
    yield rf"spdx license identifier (?P<chain>{every})", "spdx", IDENTIFIER
    yield rf"(?:(?:dual |double |triple )?licen[sc]ed(?: under| by| as| with)?(?: the)?(?: terms of)?(?: the)?(?: either)?) (?P<chain>{every})", "licensed,licenced", GRANT
    yield rf"licen[sc]es?(?: is| are| type| name)? (?P<chain>{every})", "license,licence,licenses,licences", TITLE
    plain = [n for n, label in names().items() if label.split("-")[0].rstrip("+") in FAMILIES]
    yield rf"(?P<chain>{_chain(plain, 2)})", ",".join(sorted({n.split()[0] for n in plain if _versioned(n)})), TITLE


def _versioned(name: str) -> bool:
    return bool(re.search(r"\d", name)) and not name.startswith(("mit", "0bsd"))


@cache
def rules() -> tuple[Rule, ...]:
    """All rules in order: identifiers, then the written ones, then those of alternatives."""
    out: list[Rule] = []

    def add(pattern: str, keywords: str, label: str, priority: int) -> None:
        out.append(Rule(re.compile(rf"(?<![^ ]){pattern}(?![^ ])"), tuple(keywords.split(",")), label, priority, len(out)))

    for pair in SPDX.replace("\n", " ").split(","):
        name, label = pair.split()
        add(f"spdx license identifier {re.sub('[-.]', ' ', name.lower())}", "spdx", label, IDENTIFIER)
    for line in RULES.strip().split("\n"):
        if not line.startswith("#"):
            head, pattern = line.split(": ", 1)
            for name, part in PARTS.items():
                pattern = pattern.replace(name, part)
            label, priority, keywords = head.split()
            add(pattern, keywords, label, int(priority))
    for pattern, keywords, priority in _alternatives():
        add(pattern, keywords, "", priority)
    return tuple(out)


@cache
def _prefilter() -> tuple[ahocorasick.Automaton, dict[str, list[Rule]]]:
    by: dict[str, list[Rule]] = {}
    for rule in rules():
        for keyword in rule.keywords:
            by.setdefault(keyword, []).append(rule)
    automaton = ahocorasick.Automaton()
    for key in (*by, *(p for p, _ in BASE)):
        automaton.add_word(f" {key} ", key)
    automaton.make_automaton()
    return automaton, by


def normalised(text: str | None) -> str:
    """' word word ... ' of a text's words, runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after lower-casing A-Z; ' ' if none."""
    words = (text or "").translate(_TABLE).split(" ")
    return f" {' '.join(filter(None, words))} " if any(words) else " "


_TABLE = {c: (chr(c).lower() if chr(c).isalnum() else " ") for c in range(128)}


@dataclass(frozen=True)
class Detection:
    start: int  # first word
    end: int  # word after the last
    label: str
    priority: int


def matches(joined: str, chosen: Iterable[Rule]) -> list[tuple[int, int, int, int, str]]:
    """(first character, character after the last, priority, order, label) of all matches of rules; a title after words of a grant takes them in and their priority. Titles after words that deny them, and those that
    name another thing ("license office"), are none."""
    out = []
    for rule in chosen:
        for m in rule.pattern.finditer(joined):
            start, priority = m.start(), rule.priority
            if rule.priority < GRANT or not rule.label:
                if priority < GRANT and (g := _GRANT.search(joined, max(0, start - _GRANT_CHARS), start)):
                    start, priority = g.start(), GRANT
                if priority < IDENTIFIER and (_DENIED.search(joined, max(0, start - _DENIED_CHARS), start) or _OTHER_THING.match(joined, m.end())):
                    continue
            if rule.label:
                version = m["v"] if "v" in rule.pattern.groupindex else None
                out.append((start, m.end(), priority, rule.order, f"{rule.label}-{version.removesuffix(' 0').replace(' ', '.')}" if version else rule.label))
                continue
            members = list(_members().finditer(joined, m.start("chain"), m.end("chain")))
            if m.start("chain") > m.start() or any(_versioned(x["name"]) for x in members):
                out += [(start if x is members[0] else x.start(), x.end(), priority, rule.order, names()[x["name"]]) for x in members]
    return out


def settled(found: list[tuple[int, int, int, int, str]]) -> list[tuple[int, int, int, int, str]]:
    """What remains of matches, by place: first those go that lie within a longer one, or in the same place as one of higher priority or earlier order; of those that still
    overlap, the one of higher priority, then the longer, then the earlier rule's, then the first stays."""
    alone: list[tuple[int, int, int, int, str]] = []
    reach = -1
    for f in sorted(set(found), key=lambda f: (f[0], -f[1], -f[2], f[3])):
        if f[1] > reach:  # no earlier or equal start reaches as far
            alone.append(f)
            reach = f[1]
    kept: list[tuple[int, int, int, int, str]] = []
    ends: list[tuple[int, int]] = []  # kept intervals by start; they don't overlap
    for f in sorted(alone, key=lambda f: (-f[2], f[0] - f[1], f[3], f[0])):
        at = bisect.bisect_left(ends, (f[1], -1))
        if not at or ends[at - 1][1] <= f[0]:
            bisect.insort(ends, f[:2])
            kept.append(f)
    return sorted(kept)


def detect(joined: str) -> tuple[list[tuple[int, int]], list[Detection]]:
    """((phrase number, first word) of all base places, detections that remain) of a normalised text."""
    automaton, by = _prefilter()
    keys = {key for _, key in automaton.iter(joined)}
    if not keys:
        return [], []
    starts = np.flatnonzero(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4") == 32)
    places = []
    for k, (phrase, _) in enumerate(BASE):
        at = joined.find(f" {phrase} ") if phrase in keys else -1
        while at >= 0:
            places.append((k, int(np.searchsorted(starts, at))))
            at = joined.find(f" {phrase} ", at + 1)
    chosen = {rule.order: rule for key in keys & by.keys() for rule in by[key]}
    kept = settled(matches(joined, chosen.values()))
    first, last = np.searchsorted(starts, [f[0] - 1 for f in kept]).tolist(), np.searchsorted(starts, [f[1] for f in kept]).tolist()
    return places, [Detection(a, b, f[4], f[2]) for a, b, f in zip(first, last, kept, strict=True)]


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with kd_words, kd_base (places), kd_first, kd_last, kd_base_labels, kd_labels, kd_score and kd_spans (label, first word, word after the last).

    kd_score is 0 without a detection, else 0.25 a level of the best priority; a base place counts as a grant. A null or empty text has no words and no labels, a long one
    is scanned whole. Overlaps and ties are settled as `settled` says; rows that repeat get the same result, an empty table gives none. Columns of docs pass
    through, but those with names of the added ones are replaced by them.
    """
    more = "kd_words long, kd_base long, kd_first long, kd_last long, kd_base_labels string, kd_labels string, kd_score double, kd_spans array<struct<label:string,start:long,end:long>>"
    docs = without(docs, more)
    column, own = docs.columns.index(text_col), docs.columns
    schema = extended(docs, more)
    names = schema.names[len(own) :]
    spans = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, part in slices(b, column):
                rows = []
                for text in part:
                    joined = normalised(text)
                    places, found = detect(joined)
                    at = [w for _, w in places]
                    base = {BASE[k][1] for k, _ in places}
                    score = max([GRANT if places else 0, *(d.priority for d in found)]) / 4
                    rows.append((
                        joined.count(" ") - 1, len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {d.label for d in found})), score,
                        [{"label": d.label, "start": d.start, "end": d.end} for d in found],
                    ))
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.slice(start, len(part)) for c in b.columns), *columns], [*own, *names])

    return mapped(docs, run, schema)


def op5_licenses(docs: DataFrame) -> DataFrame:
    """The contract's columns of `scan`, which states all odd cases."""
    names = {"n_words": "kd_words", "n_base": "kd_base", "first_word": "kd_first", "last_word": "kd_last", "base_labels": "kd_base_labels", "labels": "kd_labels", "score": "kd_score"}
    return scan(docs.select("doc_id", "text")).select("doc_id", *(F.col(c).alias(n) for n, c in names.items()))
