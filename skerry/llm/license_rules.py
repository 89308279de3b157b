"""Signature rules of operator 8, written by hand, one in a line: label | priority | regular expression.

Expressions match texts whose words are in lower case with one space between them, so "v2.0" is "v2 0" and "MIT-style" is
"mit style"; they begin and end with whole words. Priorities: 1 identifiers and addresses, 2 sentences of a licence's own
text, 3 notices and grants that name a licence, 4 names with a version or the like, 5 bare names and weak clues.
"""

from __future__ import annotations

import re

# What licences and their notices say.
RULES = r"""
mit | 1 | spdx license identifier mit
mit-0 | 1 | spdx license identifier mit 0
apache-1.1 | 1 | spdx license identifier apache 1 1
apache-2.0 | 1 | spdx license identifier apache 2 0
gpl-1.0 | 1 | spdx license identifier gpl 1 0(?: only| or later)?
gpl-2.0 | 1 | spdx license identifier gpl 2 0(?: only| or later)?
gpl-3.0 | 1 | spdx license identifier gpl 3 0(?: only| or later)?
lgpl-2.0 | 1 | spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2.1 | 1 | spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3.0 | 1 | spdx license identifier lgpl 3 0(?: only| or later)?
agpl-3.0 | 1 | spdx license identifier agpl 3 0(?: only| or later)?
gfdl | 1 | spdx license identifier gfdl 1 [1-3](?: only| or later)?
bsd-1-clause | 1 | spdx license identifier bsd 1 clause
bsd-2-clause | 1 | spdx license identifier bsd 2 clause(?: patent| views)?
bsd-3-clause | 1 | spdx license identifier bsd 3 clause(?: clear| lbnl)?
bsd-4-clause | 1 | spdx license identifier bsd 4 clause(?: uc)?
0bsd | 1 | spdx license identifier 0bsd
mpl-1.1 | 1 | spdx license identifier mpl 1 1
mpl-2.0 | 1 | spdx license identifier mpl 2 0(?: no copyleft exception)?
epl-1.0 | 1 | spdx license identifier epl 1 0
epl-2.0 | 1 | spdx license identifier epl 2 0
cddl | 1 | spdx license identifier cddl 1 [01]
cpl | 1 | spdx license identifier cpl 1 0
isc | 1 | spdx license identifier isc
zlib | 1 | spdx license identifier zlib(?: acknowledgement)?
boost | 1 | spdx license identifier bsl 1 0
unlicense | 1 | spdx license identifier unlicense
wtfpl | 1 | spdx license identifier wtfpl
artistic | 1 | spdx license identifier artistic (?:1|2) 0(?: perl)?
python | 1 | spdx license identifier (?:psf|python) 2 0(?: 1)?
php | 1 | spdx license identifier php 3 0[1]?
ruby | 1 | spdx license identifier ruby
openssl | 1 | spdx license identifier openssl
postgresql | 1 | spdx license identifier postgresql
eupl | 1 | spdx license identifier eupl 1 [0-2]
cecill | 1 | spdx license identifier cecill(?: [bc]| 1 [01]| 2 [01])?
ms-pl | 1 | spdx license identifier ms pl
ms-rl | 1 | spdx license identifier ms rl
osl | 1 | spdx license identifier osl [123] [01]
afl | 1 | spdx license identifier afl [123] [012]
ofl | 1 | spdx license identifier ofl 1 [01]
odbl | 1 | spdx license identifier odbl 1 0
odc-by | 1 | spdx license identifier odc by 1 0
pddl | 1 | spdx license identifier pddl 1 0
cc0 | 1 | spdx license identifier cc0 1 0
cc-by | 1 | spdx license identifier cc by [1-4] [05]
cc-by-sa | 1 | spdx license identifier cc by sa [1-4] [05]
cc-by-nc | 1 | spdx license identifier cc by nc [1-4] [05]
cc-by-nd | 1 | spdx license identifier cc by nd [1-4] [05]
cc-by-nc-sa | 1 | spdx license identifier cc by nc sa [1-4] [05]
cc-by-nc-nd | 1 | spdx license identifier cc by nc nd [1-4] [05]
ncsa | 1 | spdx license identifier ncsa
unicode | 1 | spdx license identifier unicode (?:dfs 201[56]|3 0)
w3c | 1 | spdx license identifier w3c(?: 19980720| 20150513)?
blueoak | 1 | spdx license identifier blueoak 1 0 0
sspl | 1 | spdx license identifier sspl 1 0
busl | 1 | spdx license identifier busl 1 1
elastic | 1 | spdx license identifier elastic 2 0
vim | 1 | spdx license identifier vim
curl | 1 | spdx license identifier curl
tcl | 1 | spdx license identifier tcl
mit | 1 | opensource org licenses mit(?: license)?(?: php| html)?
apache-2.0 | 1 | apache org licenses license 2 0(?: txt| html)?
apache-2.0 | 1 | opensource org licenses apache 2 0
gpl-2.0 | 1 | gnu org (?:licenses (?:old licenses )?)?gpl 2 0(?: txt| html)?
gpl-3.0 | 1 | gnu org licenses gpl 3 0(?: txt| html| en html)?
gpl | 1 | gnu org licenses gpl(?: txt| html)?
gpl | 1 | gnu org copyleft gpl html
lgpl | 1 | gnu org licenses lgpl(?: [23] [01])?(?: txt| html)?
lgpl | 1 | gnu org copyleft lesser html
agpl-3.0 | 1 | gnu org licenses agpl(?: 3 0)?(?: txt| html)?
gfdl | 1 | gnu org licenses fdl(?: 1 3)?(?: txt| html)?
bsd-2-clause | 1 | opensource org licenses bsd 2 clause
bsd-3-clause | 1 | opensource org licenses bsd 3 clause
bsd | 1 | opensource org licenses bsd license(?: php)?
mpl-2.0 | 1 | mozilla org mpl 2 0
mpl-1.1 | 1 | mozilla org mpl mpl 1 1(?: html)?
epl-1.0 | 1 | eclipse org legal epl v10(?: html)?
epl-2.0 | 1 | eclipse org (?:legal|org documents) epl (?:2 0|v20)
boost | 1 | boost org license 1 0 txt
unlicense | 1 | unlicense org
cc0 | 1 | creativecommons org publicdomain zero 1 0(?: legalcode)?
public-domain | 1 | creativecommons org publicdomain mark 1 0
cc-by | 1 | creativecommons org licenses by [1-4] [05]
cc-by-sa | 1 | creativecommons org licenses by sa [1-4] [05]
cc-by-nc | 1 | creativecommons org licenses by nc [1-4] [05]
cc-by-nd | 1 | creativecommons org licenses by nd [1-4] [05]
cc-by-nc-sa | 1 | creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-nd | 1 | creativecommons org licenses by nc nd [1-4] [05]
odbl | 1 | opendatacommons org licenses odbl(?: 1 0| summary)?
odc-by | 1 | opendatacommons org licenses by(?: 1 0| summary)?
pddl | 1 | opendatacommons org licenses pddl(?: 1 0| summary)?
ofl | 1 | scripts sil org ofl
php | 1 | php net license(?: 3 0[01])?(?: txt)?
wtfpl | 1 | wtfpl net
mit | 2 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 2 | permission is hereby granted free of charge to any person obtaining a copy
mit | 2 | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies(?: of the software)? and to permit persons
mit | 2 | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 2 | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and non ?infringement
mit | 2 | in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise
x11 | 2 | except as contained in this notice the names? of(?: [^ ]+){1,10} shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization
mit-feh | 2 | the above copyright notice and this permission notice shall be included in all copies of the software and its documentation and acknowledgment shall be given
hpnd | 2 | permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted provided that the above copyright notice appears? in all copies
hpnd | 2 | makes no representations about the suitability of this software for any purpose it is provided as is without express or implied warranty
isc | 2 | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
isc | 2 | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
isc | 2 | the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
bsd | 2 | redistribution and use in source and binary forms with or without modification are permitted
bsd | 2 | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | 2 | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution
bsd-3-clause | 2 | neither the names? of(?: [^ ]+){1,14} nor the names of (?:its|their|any) contributors may be used to endorse or promote products derived from this software without specific prior written permission
bsd-3-clause | 2 | may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause | 2 | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-4-clause | 2 | copyright(?: [^ ]+){1,14} all advertising materials mentioning features or use of this software must display
bsd | 2 | this software is provided by(?: [^ ]+){1,14} as is and any express(?:ed)? or implied warranties including but not limited to the implied warranties of merchantability
bsd-2-clause | 2 | the views and conclusions contained in the software and documentation are those of the authors and should not be interpreted as representing official policies
bsd-3-clause-clear | 2 | no express or implied licenses to any party s patent rights are granted by this license
apache-2.0 | 2 | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2.0 | 2 | you may not use this file except in compliance with the license you may obtain a copy of the license at
apache | 2 | you may not use this file except in compliance with the license
apache | 2 | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind
apache | 2 | see the license for the specific language governing permissions and limitations under the license
apache-2.0 | 2 | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-2.0 | 2 | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable except as stated in this section patent license
apache-2.0 | 2 | you must give any other recipients of the work or derivative works a copy of this license
apache-2.0 | 2 | this license does not grant permission to use the trade names trademarks service marks or product names of the licensor
apache-1.1 | 2 | the end user documentation included with the redistribution if any must include the following acknowledge?ment
apache-1.1 | 2 | products derived from this software may not be called apache(?: [^ ]+){0,4} nor may apache appear in their name without prior written permission
apache-1.1 | 2 | this product includes software developed by the apache (?:software foundation|group)
gpl | 2 | is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation
gpl-2.0 | 2 | under the terms of the gnu general public license as published by the free software foundation either version 2(?: of the license)? or at your option any later version
gpl-3.0 | 2 | under the terms of the gnu general public license as published by the free software foundation either version 3(?: of the license)? or at your option any later version
gpl | 2 | license as published by the free software foundation either version [123](?: of the license)?(?: or at your option any later version)?
gpl | 2 | you should have received a copy of the gnu general public license along with
gpl | 2 | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details
gpl | 2 | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
gpl-2.0 | 2 | the licenses for most software are designed to take away your freedom to share and change it
gpl-3.0 | 2 | the gnu general public license is a free copyleft license for software and other kinds of works
gpl-3.0 | 2 | the licenses for most software and other practical works are designed to take away your freedom to share and change the works
gpl-2.0 | 2 | you may copy and distribute verbatim copies of the program s source code as you receive it in any medium provided that you
gpl-3.0 | 2 | all rights granted under this license are granted for the term of copyright on the program and are irrevocable provided the stated conditions are met
gpl-3.0 | 2 | no covered work shall be deemed part of an effective technological measure(?: [^ ]+){1,20} copyright treaty
gpl | 2 | this program comes with absolutely no warranty
gpl | 2 | this is free software and you are welcome to redistribute it under certain conditions
gpl-classpath | 2 | as a special exception the copyright holders of this library give you permission to link this library with independent modules
gpl-openssl | 2 | as a special exception(?: [^ ]+){1,14} permission to link(?: [^ ]+){1,10} with the openssl library
gcc-exception | 2 | under section 7 of gpl version 3 you are granted additional permissions described in the gcc runtime library exception
autoconf-exception | 2 | as a special exception the free software foundation gives unlimited permission to copy distribute and modify
lgpl | 2 | under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation
lgpl-2.1 | 2 | under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation either version 2 1(?: of the license)?
lgpl-3.0 | 2 | under the terms of the gnu lesser general public license as published by the free software foundation either version 3(?: of the license)?
lgpl | 2 | you should have received a copy of the gnu (?:lesser|library) general public license along with
lgpl | 2 | this license the lesser general public license applies to some specially designated software packages
lgpl-3.0 | 2 | this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license
lgpl | 2 | see the gnu (?:lesser|library) general public license for more details
agpl-3.0 | 2 | under the terms of the gnu affero general public license as published by the free software foundation
agpl-3.0 | 2 | you should have received a copy of the gnu affero general public license along with
agpl-3.0 | 2 | the gnu affero general public license is a free copyleft license for software and other kinds of works
agpl-3.0 | 2 | your modified version must prominently offer all users interacting with it remotely through a computer network
agpl | 2 | see the gnu affero general public license for more details
gfdl | 2 | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl | 2 | with no invariant sections(?: with)? no front cover texts and(?: with)? no back cover texts a copy of the license is included
mpl-2.0 | 2 | this source code form is subject to the terms of the mozilla public license(?: v| version) ?2 0
mpl | 2 | this source code form is subject to the terms of the mozilla public license
mpl-2.0 | 2 | if a copy of the mpl was not distributed with this file you can obtain one at (?:https? )?(?:www )?mozilla org mpl 2 0
mpl-1.1 | 2 | the contents of this file are subject to the mozilla public license version 1 1
mpl-1.1 | 2 | software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied see the license for the specific language governing rights and limitations
mpl-1.1 | 2 | alternatively the contents of this file may be used under the terms of either the gnu general public license version 2 or later
mpl-2.0 | 2 | this source code form is incompatible with secondary licenses as defined by the mozilla public license
epl-1.0 | 2 | this program and the accompanying materials are made available under the terms of the eclipse public license (?:v ?|version )?1 0
epl-2.0 | 2 | this program and the accompanying materials are made available under the terms of the eclipse public license (?:v ?|version )?2 0
epl | 2 | this program and the accompanying materials are made available under the terms of the eclipse public license
epl | 2 | the accompanying program is provided under the terms of this eclipse public license
edl | 2 | are made available under the terms of the eclipse distribution license
cpl | 2 | the accompanying program is provided under the terms of this common public license
cddl | 2 | the contents of this file are subject to the terms of the common development and distribution license
cddl | 2 | when distributing covered code include this cddl header(?: notice)? in each file and include the license file
ibm-pl | 2 | the accompanying program is provided under the terms of this ibm public license
zlib | 2 | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
zlib | 2 | permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely
zlib | 2 | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
boost | 2 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
boost | 2 | distributed under the boost software license version 1 0
boost | 2 | the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software
unlicense | 2 | this is free and unencumbered software released into the public domain
unlicense | 2 | anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose
unlicense | 2 | in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain
wtfpl | 2 | do what the fuck you want to public license
wtfpl | 2 | you just do what the fuck you want to
cc0 | 2 | the person who associated a work with this deed has dedicated the work to the public domain by waiving all of (?:his or her|their) rights to the work worldwide under copyright law
cc0 | 2 | to the extent possible under law(?: [^ ]+){1,10} has waived all copyright and related or neighboring rights to
cc0 | 2 | affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of affirmer s copyright and related rights
cc-by | 2 | you are free to share copy and redistribute the material in any medium or format and adapt remix transform and build upon the material for any purpose even commercially
cc-by | 2 | you must give appropriate credit provide a link to the license and indicate if changes were made
cc-by-sa | 2 | if you remix transform or build upon the material you must distribute your contributions under the same license as the original
cc-by-nc | 2 | you may not use the material for commercial purposes
cc-by-nd | 2 | if you remix transform or build upon the material you may not distribute the modified material
cc | 2 | by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons
cc | 2 | the work as defined below is provided under the terms of this creative commons public license
ofl | 2 | this font software is licensed under the sil open font license version 1 1
ofl | 2 | permission is hereby granted free of charge to any person obtaining a copy of the font software to use study copy merge embed modify redistribute and sell
ofl | 2 | neither the font software nor any of its individual components in original or modified versions may be sold by itself
artistic | 2 | the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control
artistic-2.0 | 2 | this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed
artistic | 2 | you may make and give away verbatim copies of the (?:source|standard version)(?: [^ ]+){1,10} without restriction provided that you duplicate all of the original copyright notices
python | 2 | this license agreement is between the python software foundation psf and the individual or organization licensee accessing and otherwise using
python | 2 | psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce analyze test perform and or display publicly
python | 2 | psf is making python available to licensee on an as is basis
php | 2 | products derived from this software may not be called php nor may php appear in their name without prior written permission
php | 2 | this source file is subject to version 3 0[01] of the php license
openssl | 2 | this product includes software developed by the openssl project for use in the openssl toolkit
openssl | 2 | the names openssl toolkit and openssl project must not be used to endorse or promote products derived from this software without prior written permission
ssleay | 2 | this product includes cryptographic software written by eric young
postgresql | 2 | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
eupl | 2 | licensed under the eupl (?:version |v )?1 [0-2](?: or as soon they will be approved by the european commission subsequent versions of the eupl)?
eupl | 2 | this european union public licen[cs]e the eupl applies to the work
cecill | 2 | this software is governed by the cecill(?: [bc])? license under french law and abiding by the rules of distribution of free software
ms-pl | 2 | this license governs use of the accompanying software if you use the software you accept this license
ms-rl | 2 | for any file you distribute that contains code from the software in source code or binary format you must provide recipients the source code to that file along with a copy of this license
osl | 2 | licensed under the open software license version [123] [01]
afl | 2 | licensed under the academic free license version [123] [012]
odbl | 2 | this(?: [^ ]+){1,10} is made available under the open database license
odbl | 2 | any rights in individual contents of the database are licensed under the database contents license
odc-by | 2 | this(?: [^ ]+){1,10} is made available under the open data commons attribution license
pddl | 2 | this(?: [^ ]+){1,10} is made available under the public domain dedication and license
ncsa | 2 | to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense
unicode | 2 | permission is hereby granted free of charge to any person obtaining a copy of (?:the )?(?:unicode )?data files and any associated documentation
w3c | 2 | permission to copy modify and distribute this (?:work|software and its documentation) with or without modification for any purpose and without fee or royalty is hereby granted
blueoak | 2 | each contributor licenses you to do everything with this software that would otherwise infringe that contributor s copyright in it
sspl | 2 | if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available
busl | 2 | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
busl | 2 | effective on the change date(?: [^ ]+){1,20} the licensor hereby grants you rights under the terms of the change license
elastic | 2 | you may not provide the software to third parties as a hosted or managed service
commons-clause | 2 | the software is provided to you by the licensor under the license as defined below subject to the following condition
commons-clause | 2 | the grant of rights under the license will not include and the license does not grant to you the right to sell the software
openrail | 2 | you agree not to use the model or derivatives of the model
openrail | 2 | use based restrictions as referenced in paragraph 5 must be included as an enforceable provision by you in any type of legal agreement
llama | 2 | you are granted a non exclusive worldwide non transferable and royalty free limited license under meta s intellectual property
llama | 2 | if you use the llama materials(?: [^ ]+){1,20} you shall also include llama at the beginning of any such ai model name
vim | 2 | there are no restrictions on distributing unmodified copies of vim except that they must include this license text
curl | 2 | copyright c(?: [^ ]+){1,10} daniel stenberg
tcl | 2 | the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose
ijg | 2 | permission is hereby granted to use copy modify and distribute this software or portions thereof for any purpose without fee subject to these conditions
libpng | 2 | permission is hereby granted to use copy modify and distribute this source code or portions hereof for any purpose without fee
sleepycat | 2 | redistributions in any form must be accompanied by information on how to obtain complete source code for the db software
json | 2 | the software shall be used for good not evil
beerware | 2 | as long as you retain this notice you can do whatever you want with this stuff
fsfap | 2 | copying and distribution of this file with or without modification are permitted in any medium without royalty provided the copyright notice and this notice are preserved
fsful | 2 | this configure script is free software the free software foundation gives unlimited permission to copy distribute and modify it
gnu-all-permissive | 2 | this file is offered as is without any warranty
naist | 2 | permission to use copy modify and distribute(?: [^ ]+){1,14} is hereby granted provided the above copyright notice appears in all copies and that both that copyright notice and this permission notice appear in supporting documentation
public-domain | 2 | (?:is|are|has been|have been|was|were) (?:hereby )?(?:released|placed|put|dedicated) (?:in|into|in to|to) the public domain
public-domain | 2 | the authors? (?:hereby )?(?:disclaims?|waives?|abandons?) (?:all )?copyright to this (?:source code|work|file|software)
public-domain | 2 | this (?:file|work|code|software|program|text|image|document) is in the public domain
public-domain | 2 | no copyright is claimed(?: [^ ]+){0,10}
public-domain | 2 | not subject to copyright protection in the united states
us-gov | 2 | this is a work of the u(?:nited)? ?s(?:tates)? government(?: [^ ]+){1,10} public domain
proprietary | 2 | this (?:software|document|file|work|program) contains confidential(?: and| or)? proprietary information of 
proprietary | 2 | may not be (?:copied|reproduced|used|distributed|disclosed)(?: [^ ]+){0,10} without(?: the)? (?:prior|express|explicit)(?: express)?(?: written)? permission
proprietary | 2 | may not be copied without a licen[cs]e
proprietary | 2 | unauthori[sz]ed (?:copying|use|reproduction|distribution) of this (?:file|software|document|program|work)(?: [^ ]+){0,10} is strictly prohibited
proprietary | 2 | no part of this (?:publication|book|document|work|site|website) may be reproduced(?: [^ ]+){0,20} without(?: the)?(?: prior)?(?: written)? permission
proprietary | 2 | licensed for internal use only
eula | 2 | by (?:installing|using|downloading|copying)(?: [^ ]+){1,14} you (?:agree|accept|consent) to (?:be bound by )?the terms of this (?:end user )?licen[cs]e(?: agreement)?
eula | 2 | this end user licen[cs]e agreement(?: eula)? is a legal agreement between you
eula | 2 | the software is licensed not sold
mit | 3 | (?:licensed|released|distributed|available|provided|published|offered) under(?: the)?(?: terms of(?: the)?)? (?:mit|expat|x11)(?: style)? licen[cs]e
apache-2.0 | 3 | (?:licensed|released|distributed|available|provided|published|offered) under(?: the)?(?: terms of(?: the)?)? apache(?: software)? licen[cs]e (?:version |v ?)?2(?: 0)?
apache-2.0 | 3 | (?:licensed|released|distributed|available|provided|published|offered) under(?: the)?(?: terms of(?: the)?)? apache(?: version| v)? ?2(?: 0)?
apache | 3 | (?:licensed|released|distributed|available|provided|published|offered) under(?: the)?(?: terms of(?: the)?)? apache(?: software)? licen[cs]e
gpl-2.0 | 3 | (?:licensed|released|distributed|available|provided|published|offered) under(?: the)?(?: terms of(?: the)?)?(?: gnu)? (?:general public licen[cs]e|gpl) ?(?:version |v ?)?2(?: 0)?(?: or later| or any later version)?
gpl-3.0 | 3 | (?:licensed|released|distributed|available|provided|published|offered) under(?: the)?(?: terms of(?: the)?)?(?: gnu)? (?:general public licen[cs]e|gpl) ?(?:version |v ?)?3(?: 0)?(?: or later| or any later version)?
gpl | 3 | (?:licensed|released|distributed|available|provided|published|offered) under(?: the)?(?: terms of(?: the)?)?(?: gnu)? (?:general public licen[cs]e|gpl)
lgpl | 3 | (?:licensed|released|distributed|available|provided|published|offered) under(?: the)?(?: terms of(?: the)?)?(?: gnu)? (?:(?:lesser|library) general public licen[cs]e|lgpl)(?: (?:version |v ?)?[23](?: [01])?)?
agpl | 3 | (?:licensed|released|distributed|available|provided|published|offered) under(?: the)?(?: terms of(?: the)?)?(?: gnu)? (?:affero general public licen[cs]e|agpl)(?: (?:version |v ?)?[13](?: 0)?)?
gfdl | 3 | (?:licensed|released|distributed|available|provided|published|offered) under(?: the)?(?: terms of(?: the)?)?(?: gnu)? (?:free documentation licen[cs]e|gfdl|fdl)(?: (?:version |v ?)?1 [1-3])?
bsd-2-clause | 3 | (?:licensed|released|distributed|available|provided|published|offered) under(?: the)?(?: terms of(?: the)?)? (?:simplified bsd|freebsd|(?:2|two) clause bsd|bsd (?:2|two) clause) licen[cs]e
bsd-3-clause | 3 | (?:licensed|released|distributed|available|provided|published|offered) under(?: the)?(?: terms of(?: the)?)? (?:new bsd|modified bsd|revised bsd|(?:3|three) clause bsd|bsd (?:3|three) clause) licen[cs]e
bsd | 3 | (?:licensed|released|distributed|available|provided|published|offered) under(?: the| a)?(?: terms of(?: the)?)? bsd(?: style| type| like)? licen[cs]e
mpl | 3 | (?:licensed|released|distributed|available|provided|published|offered) under(?: the)?(?: terms of(?: the)?)? (?:mozilla public licen[cs]e|mpl)(?: (?:version |v ?)?[12] [01])?
epl | 3 | (?:licensed|released|distributed|available|provided|published|offered) under(?: the)?(?: terms of(?: the)?)? (?:eclipse public licen[cs]e|epl)(?: (?:version |v ?)?[12](?: 0)?)?
cddl | 3 | (?:licensed|released|distributed|available|provided|published|offered) under(?: the)?(?: terms of(?: the)?)? (?:common development and distribution licen[cs]e|cddl)(?: (?:version |v ?)?1 [01])?
isc | 3 | (?:licensed|released|distributed|available|provided|published|offered) under(?: the)?(?: terms of(?: the)?)? isc licen[cs]e
zlib | 3 | (?:licensed|released|distributed|available|provided|published|offered) under(?: the)?(?: terms of(?: the)?)? zlib(?: libpng)? licen[cs]e
boost | 3 | (?:licensed|released|distributed|available|provided|published|offered) under(?: the)?(?: terms of(?: the)?)? boost(?: software)? licen[cs]e(?: version 1 0)?
unlicense | 3 | (?:licensed|released|distributed|available|provided|published|offered) under(?: the)?(?: terms of(?: the)?)? unlicen[cs]e
artistic | 3 | (?:licensed|released|distributed|available|provided|published|offered) under(?: the)?(?: terms of(?: the)?)?(?: perl)? artistic licen[cs]e(?: (?:version |v ?)?[12](?: 0)?)?
perl | 3 | you can redistribute it and or modify it under the same terms as perl itself
perl | 3 | licensed under the same terms as perl itself
python | 3 | (?:licensed|released|distributed|available|provided|published|offered) under(?: the)?(?: terms of(?: the)?)? (?:python software foundation|python|psf) licen[cs]e(?: (?:version |v ?)?2(?: 0)?)?
cc0 | 3 | (?:licensed|released|distributed|available|provided|published|offered) under(?: the| a)?(?: terms of(?: the)?)? (?:creative commons )?(?:cc0|cc zero|commons zero)(?: 1 0)?(?: universal)?(?: licen[cs]e)?
cc-by | 3 | (?:licensed|released|distributed|available|provided|published|offered) under(?: the| a)?(?: terms of(?: the)?)? (?:creative commons attribution|cc by)(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?
cc-by-sa | 3 | (?:licensed|released|distributed|available|provided|published|offered) under(?: the| a)?(?: terms of(?: the)?)? (?:creative commons attribution share ?alike|cc by sa)(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?
cc-by-nc | 3 | (?:licensed|released|distributed|available|provided|published|offered) under(?: the| a)?(?: terms of(?: the)?)? (?:creative commons attribution non ?commercial|cc by nc)(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?
cc-by-nd | 3 | (?:licensed|released|distributed|available|provided|published|offered) under(?: the| a)?(?: terms of(?: the)?)? (?:creative commons attribution no ?deriv(?:ative)?s?(?: works)?|cc by nd)(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?
cc-by-nc-sa | 3 | (?:licensed|released|distributed|available|provided|published|offered) under(?: the| a)?(?: terms of(?: the)?)? (?:creative commons attribution non ?commercial share ?alike|cc by nc sa)(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?
cc-by-nc-nd | 3 | (?:licensed|released|distributed|available|provided|published|offered) under(?: the| a)?(?: terms of(?: the)?)? (?:creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?|cc by nc nd)(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?
ofl | 3 | (?:licensed|released|distributed|available|provided|published|offered) under(?: the)?(?: terms of(?: the)?)?(?: sil)? open font licen[cs]e(?: (?:version |v ?)?1 [01])?
odbl | 3 | (?:licensed|released|distributed|available|provided|published|offered) under(?: the)?(?: terms of(?: the)?)? (?:open database licen[cs]e|odbl)(?: (?:version |v ?)?1 0)?
eupl | 3 | (?:licensed|released|distributed|available|provided|published|offered) under(?: the)?(?: terms of(?: the)?)? (?:european union public licen[cs]e|eupl)(?: (?:version |v ?)?1 [0-2])?
wtfpl | 3 | (?:licensed|released|distributed|available|provided|published|offered) under(?: the)?(?: terms of(?: the)?)? wtfpl(?: licen[cs]e)?
sspl | 3 | (?:licensed|released|distributed|available|provided|published|offered) under(?: the)?(?: terms of(?: the)?)? server side public licen[cs]e(?: v ?1)?
busl | 3 | (?:licensed|released|distributed|available|provided|published|offered) under(?: the)?(?: terms of(?: the)?)? business source licen[cs]e(?: 1 1)?
elastic | 3 | (?:licensed|released|distributed|available|provided|published|offered) under(?: the)?(?: terms of(?: the)?)? elastic licen[cs]e(?: (?:v ?)?2(?: 0)?)?
dual-license | 3 | (?:dual|multi|triple) licensed under
see-license | 3 | see (?:the )?(?:accompanying )?(?:file )?(?:licen[cs]e|copying)(?: txt| md)?(?: file)? for (?:(?:the )?(?:full )?licen[cs]e )?(?:details|terms|more information|copyright)
proprietary | 3 | copyright(?: c)? [0-9]{4}(?: [^ ]+){0,14} all rights reserved
proprietary | 3 | proprietary and confidential
proprietary | 3 | (?:under|subject to) (?:a|the) (?:commercial|proprietary) licen[cs]e(?: agreement)?
mit | 4 | mit licen[cs]e(?: mit)?
mit | 4 | licen[cs]e(?: is)? mit
x11 | 4 | x11 licen[cs]e
mit | 4 | expat licen[cs]e
mit | 4 | mit style licen[cs]e
mit-0 | 4 | mit no attribution(?: licen[cs]e)?
apache-2.0 | 4 | apache(?: software| public)? licen[cs]e (?:version |v ?)?2(?: 0)?
apache-1.1 | 4 | apache(?: software)? licen[cs]e (?:version |v ?)?1 [01]
apache | 4 | licen[cs]e(?: is)? apache(?: 2 0)?
gpl-2.0 | 4 | (?:gnu )?general public licen[cs]e (?:version |v ?)?2(?: 0)?
gpl-3.0 | 4 | (?:gnu )?general public licen[cs]e (?:version |v ?)?3(?: 0)?
gpl-2.0 | 4 | (?:gnu )?gpl ?v?2(?: 0)? licen[cs]e
gpl-3.0 | 4 | (?:gnu )?gpl ?v?3(?: 0)? licen[cs]e
gpl | 4 | licen[cs]e(?: is)? (?:gnu )?gpl(?: ?v?[23])?
lgpl | 4 | (?:gnu )?(?:lesser|library) general public licen[cs]e (?:version |v ?)?[23](?: [01])?
lgpl | 4 | (?:gnu )?lgpl ?v?[23](?: [01])? licen[cs]e
agpl-3.0 | 4 | (?:gnu )?affero general public licen[cs]e (?:version |v ?)?3(?: 0)?
gfdl | 4 | (?:gnu )?free documentation licen[cs]e (?:version |v ?)?1 [1-3]
bsd-2-clause | 4 | (?:2|two) clause bsd licen[cs]e
bsd-2-clause | 4 | bsd (?:2|two) clause(?: simplified)? licen[cs]e
bsd-2-clause | 4 | simplified bsd licen[cs]e
bsd-2-clause | 4 | freebsd licen[cs]e
bsd-3-clause | 4 | (?:3|three) clause bsd licen[cs]e
bsd-3-clause | 4 | bsd (?:3|three) clause(?: new| revised)? licen[cs]e
bsd-3-clause | 4 | (?:new|modified|revised) bsd licen[cs]e
bsd-4-clause | 4 | (?:original bsd|(?:4|four) clause bsd|bsd (?:4|four) clause) licen[cs]e
0bsd | 4 | zero clause bsd(?: licen[cs]e)?
mpl-1.1 | 4 | mozilla public licen[cs]e (?:version |v ?)?1 1
mpl-2.0 | 4 | mozilla public licen[cs]e (?:version |v ?)?2 0
epl-1.0 | 4 | eclipse public licen[cs]e (?:version |v ?)?1 0
epl-2.0 | 4 | eclipse public licen[cs]e (?:version |v ?)?2 0
cddl | 4 | common development and distribution licen[cs]e(?: cddl)?(?: (?:version |v ?)?1 [01])
boost | 4 | boost software licen[cs]e (?:version |v ?)?1 0
artistic-2.0 | 4 | artistic licen[cs]e (?:version |v ?)?2(?: 0)?
cc0 | 4 | creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?(?: licen[cs]e)?
cc0 | 4 | cc0 (?:1 0 )?(?:universal )?(?:licen[cs]e|public domain dedication)
cc-by | 4 | creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?
cc-by-sa | 4 | creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?
cc-by-nc | 4 | creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?
cc-by-nd | 4 | creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?
cc-by-nc-sa | 4 | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?
cc-by-nc-nd | 4 | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?
cc-by | 4 | cc by(?: [1-4] [05])?(?: licen[cs]e)?
cc-by-sa | 4 | cc by sa(?: [1-4] [05])?(?: licen[cs]e)?
cc-by-nc | 4 | cc by nc(?: [1-4] [05])?(?: licen[cs]e)?
cc-by-nd | 4 | cc by nd(?: [1-4] [05])?(?: licen[cs]e)?
cc-by-nc-sa | 4 | cc by nc sa(?: [1-4] [05])?(?: licen[cs]e)?
cc-by-nc-nd | 4 | cc by nc nd(?: [1-4] [05])?(?: licen[cs]e)?
eupl | 4 | european union public licen[cs]e (?:version |v ?)?1 [0-2]
ofl | 4 | open font licen[cs]e (?:version |v ?)?1 [01]
python | 4 | python software foundation licen[cs]e (?:version |v ?)?2
php | 4 | php licen[cs]e (?:version |v ?)?3 0[01]?
llama | 4 | llama (?:[23](?: [123])? )?community licen[cs]e(?: agreement)?
sspl | 4 | server side public licen[cs]e(?: v ?1)?
busl | 4 | business source licen[cs]e(?: 1 1)?
commons-clause | 4 | commons clause licen[cs]e(?: condition)?
commons-clause | 4 | commons clause(?: restriction)? v1 0
apache | 5 | apache(?: software| public)? licen[cs]e
gpl | 5 | (?:gnu )?general public licen[cs]e
gpl | 5 | gnu public licen[cs]e
gpl | 5 | (?:gnu )?gpl licen[cs]e
lgpl | 5 | (?:gnu )?(?:lesser|library) general public licen[cs]e
lgpl | 5 | (?:gnu )?lgpl licen[cs]e
agpl | 5 | (?:gnu )?affero general public licen[cs]e
agpl | 5 | (?:gnu )?agpl licen[cs]e
gfdl | 5 | (?:gnu )?free documentation licen[cs]e
bsd | 5 | bsd(?: style| type| like)? licen[cs]e
bsd | 5 | berkeley software distribution licen[cs]e
mpl | 5 | mozilla(?: public)? licen[cs]e
mpl | 5 | mpl licen[cs]e
epl | 5 | eclipse(?: public)? licen[cs]e
edl | 5 | eclipse distribution licen[cs]e
cddl | 5 | common development and distribution licen[cs]e
cddl | 5 | cddl licen[cs]e
cpl | 5 | common public licen[cs]e
isc | 5 | isc licen[cs]e
isc | 5 | internet systems consortium licen[cs]e
zlib | 5 | zlib(?: libpng)? licen[cs]e
boost | 5 | boost(?: software)? licen[cs]e
unlicense | 5 | the unlicen[cs]e
wtfpl | 5 | wtfpl licen[cs]e
artistic | 5 | artistic licen[cs]e
python | 5 | (?:python(?: software foundation)?|psf) licen[cs]e
php | 5 | php licen[cs]e
ruby | 5 | ruby licen[cs]e
openssl | 5 | openssl licen[cs]e
ssleay | 5 | ssleay licen[cs]e
postgresql | 5 | postgres(?:ql)? licen[cs]e
eupl | 5 | (?:european union public|eupl) licen[cs]e
cecill | 5 | cecill(?: free software)? licen[cs]e(?: agreement)?
ms-pl | 5 | microsoft public licen[cs]e
ms-rl | 5 | microsoft reciprocal licen[cs]e
osl | 5 | open software licen[cs]e
afl | 5 | academic free licen[cs]e
ofl | 5 | (?:sil )?open font licen[cs]e
odbl | 5 | open database licen[cs]e
odc-by | 5 | open data commons attribution licen[cs]e
pddl | 5 | public domain dedication and licen[cs]e
cc | 5 | creative commons(?: licen[cs]e)?
cc0 | 5 | cc0 licen[cs]e
ncsa | 5 | (?:university of illinois )?ncsa(?: open source)? licen[cs]e
unicode | 5 | unicode(?: terms of use)? licen[cs]e
w3c | 5 | w3c(?: software)?(?: notice and)? licen[cs]e
blueoak | 5 | blue oak model licen[cs]e
elastic | 5 | elastic licen[cs]e
openrail | 5 | (?:creativeml )?open ?rail(?: m| s)? licen[cs]e
openrail | 5 | responsible ai licen[cs]e
openrail | 5 | bigscience rail licen[cs]e
vim | 5 | vim licen[cs]e
curl | 5 | curl licen[cs]e
tcl | 5 | tcl(?: tk)? licen[cs]e
beerware | 5 | beer ?ware licen[cs]e
json | 5 | json licen[cs]e
ipl | 5 | ibm public licen[cs]e
npl | 5 | netscape public licen[cs]e
qpl | 5 | q public licen[cs]e
rpl | 5 | reciprocal public licen[cs]e
spl | 5 | sun public licen[cs]e
cpal | 5 | common public attribution licen[cs]e
upl | 5 | universal permissive licen[cs]e
zpl | 5 | zope public licen[cs]e
lppl | 5 | latex project public licen[cs]e
mulan | 5 | mulan (?:permissive|public) (?:software )?licen[cs]e
parity | 5 | parity public licen[cs]e
prosperity | 5 | prosperity public licen[cs]e
polyform | 5 | polyform [^ ]+ licen[cs]e
copyleft | 5 | copyleft licen[cs]e
copyleft | 5 | all rights reversed copyleft
public-domain | 5 | public domain licen[cs]e
public-domain | 5 | (?:released|placed|dedicated)(?: in|into| in to| to) the public domain
public-domain | 5 | in the public domain
public-domain | 5 | (?:released|dedicated|donated) (?:in|into|to) the public domain
proprietary | 5 | proprietary licen[cs]e
proprietary | 5 | commercial licen[cs]e
proprietary | 5 | all rights reserved copyright
proprietary | 5 | copyright all rights reserved
free-software | 5 | (?:free|open source) software licen[cs]e
"""

#: Parts of words, in texts with a space at either end, of which every match of a rule holds at least one.
GATES = ["licen", "copy", "warrant", "permi", "spdx", "domain", "commons", "software", "redistribut", "apache", "gpl", "fdl ", "mpl ", "epl ", "cddl", "cc0", "cc zero", "cc by ", "odbl", "eupl", "wtfpl", "attribution", "clause bsd", "perl itself", " org ", "database", "fuck", "psf", " vim ", "llama", "the model", "this notice", "the material", "the program", "prominently offer", "legal agreement", "confidential", "unauthori"]


def parsed(text: str = RULES) -> list[tuple[str, str, int, str]]:
    """(label, regular expression, priority, keyword) of each rule; the keyword is the longest word that every match holds."""
    out = []
    for line in text.strip().splitlines():
        label, priority, regex = (x.strip() for x in line.split(" | "))
        out.append((label, regex, int(priority), max(fixed_words(regex), key=len)))
    return out


def fixed_words(regex: str) -> list[str]:
    """Whole words, and the beginnings of words, that every match of an expression holds: those outside its groups, classes and options."""
    while regex != (regex := re.sub(r"\([^()]*\)(?:\?|\{[^}]*\})?", "\0", regex)):
        pass
    regex = re.sub(r"\[[^\]]*\](?:\?|\{[^}]*\})?", "\0", regex)
    regex = re.sub(r"[a-z0-9 ]\?", "\0", regex)
    return [w for w in re.split(r"[ \0]+", regex) if w]
