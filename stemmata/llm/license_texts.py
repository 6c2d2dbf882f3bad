"""Paragraphs of the common licences and the notices that name them, in clauses; other texts that only look like licences.

``TEMPLATES`` are what the classifier is trained on and compared with; ``HELD_OUT`` are notices in other words, which
training doesn't see: they calibrate it.
"""

from __future__ import annotations


def _p(*clauses: str) -> str:
    return " ".join(clauses)


_AS_IS = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND,", "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO", "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE")
_GPL_END = "as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
_GPL_WARRANTY = "This {} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {}General Public License for more details."

TEMPLATES: dict[str, list[str]] = {
    "mit": [
        "Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT", "See the LICENSE file for the full MIT License text.", "The MIT License (MIT)",
        "Distributed under the MIT/X11 software license, see the accompanying file COPYING.", "This code is MIT licensed.",
        _p("Permission is hereby granted, free of charge, to any person obtaining a copy", "of this software and associated documentation files (the \"Software\"), to deal", "in the Software without restriction, including without limitation the rights", "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell", "copies of the Software, and to permit persons to whom the Software is", "furnished to do so, subject to the following conditions:"),
        _p("The above copyright notice and this permission notice shall be included", "in all copies or substantial portions of the Software."),
        _p(*_AS_IS, "AND NONINFRINGEMENT. IN NO EVENT SHALL THE", "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,", "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,", "OUT OF OR IN CONNECTION WITH THE SOFTWARE", "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "Released under the Apache License 2.0.", "This project is licensed under the Apache 2.0 license.", "Apache License Version 2.0, January 2004", "This product includes software developed at The Apache Software Foundation (http://www.apache.org/).",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only", "Released under the GNU General Public License.", "Licensed under the GPL version 2 or later.", "Licensed under the GPLv3.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License " + _GPL_END.format(3),
        "This file is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        _GPL_WARRANTY.format("program", ""), "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        "The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program.",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-or-later", "SPDX-License-Identifier: LGPL-3.0-only", "Released under the LGPL.", "Licensed under the LGPL v3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "GNU Library General Public License",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License " + _GPL_END.format("2.1"),
        _GPL_WARRANTY.format("library", "Lesser "), "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc.",
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only", "Released under the AGPL.", "Licensed under the AGPLv3.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License " + _GPL_END.format(3),
        _GPL_WARRANTY.format("program", "Affero "), "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.", "Released under the 2-clause BSD license.", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "New BSD License", "Simplified BSD License", "This code is BSD licensed.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License, version 2.0.", "Released under the MPL 2.0.", "Mozilla Public License Version 2.0", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.",
        "This Source Code Form is \"Incompatible With Secondary Licenses\", as defined by the Mozilla Public License, v. 2.0.",
    ],
    "epl": [
        "Licensed under the Eclipse Public License, version 2.0.", "SPDX-License-Identifier: EPL-2.0", "SPDX-License-Identifier: EPL-1.0", "Released under the Eclipse Public License.", "Licensed under the EPL.", "Eclipse Public License - v 2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.",
    ],
    "boost": [
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)", "SPDX-License-Identifier: BSL-1.0", "Licensed under the Boost Software License 1.0.", "Boost Software License - Version 1.0 - August 17th, 2003",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    ],
    "zlib": [
        "SPDX-License-Identifier: Zlib", "Licensed under the zlib license.", "Released under the zlib/libpng license.",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.", "This notice may not be removed or altered from any source distribution.",
    ],
    "wtfpl": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004", "SPDX-License-Identifier: WTFPL", "Licensed under the WTFPL.", "You just DO WHAT THE FUCK YOU WANT TO.", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."],
    "eupl": ["Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission - subsequent versions of the EUPL (the \"Licence\");", "SPDX-License-Identifier: EUPL-1.2", "Licensed under the European Union Public Licence.", "You may not use this work except in compliance with the Licence. You may obtain a copy of the Licence at: https://joinup.ec.europa.eu/software/page/eupl", "EUROPEAN UNION PUBLIC LICENCE v. 1.2"],
    "cc-by": [
        "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0", "Available under the Creative Commons Attribution license.", "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
        "This is an open access article distributed under the terms of the Creative Commons Attribution License, which permits unrestricted use, distribution, and reproduction in any medium, provided the original author and source are credited.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0", "Text is available under the Creative Commons Attribution-ShareAlike license; additional terms may apply.", "To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0", "Available under the Creative Commons Attribution-NonCommercial license.", "To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "Licensed under CC BY-NC-SA 4.0.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: CC0-1.0", "Released under CC0 1.0 Universal.", "SPDX-License-Identifier: Unlicense", "This file has been put into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law.",
    ],
    "isc": [
        "Licensed under the ISC License.", "SPDX-License-Identifier: ISC", "Released under the ISC license.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS",
    ],
    "proprietary": [
        "All rights reserved.", "All rights reserved. No part of this work may be reproduced without permission.", "This document is proprietary and confidential.", "Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "No part of this publication may be reproduced, stored in a retrieval system, or transmitted in any form or by any means, electronic, mechanical, photocopying, recording, or otherwise, without the prior written permission of the publisher.",
        "This software is the confidential and proprietary information of the company. You shall not disclose such confidential information and shall use it only in accordance with the terms of the license agreement.",
    ],
}

HELD_OUT: dict[str, list[str]] = {
    "mit": ["You may use this library under the MIT license.", "MIT License. See LICENSE.txt for details.", "Dual use is fine: the module is made available under the MIT License (Expat).", "The Software shall be used for Good, and the above permission notice shall be included in substantial portions of the Software."],
    "apache": ["The sources are available under the terms of the Apache License, Version 2.0.", "Apache 2.0 licensed; see http://www.apache.org/licenses/ for the text.", "distributed under the License on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"],
    "gpl": ["This script may be copied under the terms of the GNU General Public License, version 2.", "It is free software released under the GNU GPL; version 3 of the License or any later version.", "This package is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY, see the GNU General Public License."],
    "lgpl": ["This shared library is covered by the GNU Lesser General Public License.", "You can link with it under the terms of the GNU LGPL version 2.1 or later."],
    "agpl": ["The server is offered under the GNU Affero General Public License v3.", "Use of the service code is subject to the GNU AGPL version 3."],
    "bsd": ["Redistribution in source and binary forms is permitted provided that the above copyright notice is retained, with the following disclaimer.", "The code may be used under the terms of the three-clause BSD license.", "Neither the name of the University nor the names of its contributors may be used to endorse products derived from this software without prior written permission."],
    "mpl": ["The covered code is subject to the Mozilla Public License.", "You may obtain the Source Code Form under the MPL version 2.0."],
    "epl": ["These materials are made available under the Eclipse Public License v1.0 which accompanies this distribution.", "The plug-in is provided under the terms of the Eclipse Public License."],
    "boost": ["Use, modification and distribution are subject to the Boost Software License, Version 1.0.", "You may copy it under the Boost Software License."],
    "zlib": ["You may use this software freely under the zlib license, which says that altered versions must be plainly marked as such.", "The author will not be held liable for any damages arising from the use of this software."],
    "cc-by": ["The article is published under a Creative Commons Attribution 4.0 license.", "Photos: CC BY 4.0, see creativecommons.org/licenses/by/4.0"],
    "cc-by-sa": ["The map data may be shared under a Creative Commons Attribution-ShareAlike license.", "Content on this page is CC BY-SA 4.0 unless noted."],
    "cc-by-nc": ["These slides are under a Creative Commons Attribution-NonCommercial license.", "The pictures are CC BY-NC 4.0."],
    "public-domain": ["The author has placed this code in the public domain and waived all copyright.", "No rights reserved: the data set is released under CC0 1.0."],
    "isc": ["The tool may be copied under the ISC license.", "Permission to use, copy, modify and distribute this program for any purpose with or without fee is hereby granted."],
    "proprietary": ["Copyright 2011 by the firm. All rights reserved. Reproduction without the written permission of the publisher is strictly prohibited.", "This file is confidential and proprietary; unauthorized copying is prohibited."],
}

LOOKALIKES = [
    "She got her driving license in version 2 of the test.", "A license to practise medicine is granted by the state.", "The helicopter was an Apache built for the army.", "He studied at MIT and released two records.",
    "The public was under the impression that the work is done.", "The general public may obtain a copy of the report at the library.", "Permission to land was granted to the pilot.", "The terms of the contract are subject to change.",
    "All seats are reserved for members.", "The creative team shared the commons with the public.", "A new version of the file was released under pressure.", "You should have received a letter by now.", "This project is the source of the noise.",
    "The license fee is due in May.", "Fishing without a license is prohibited.", "This work is under way and the text is available.", "The domain of the public library is large.", "Free of charge to any person under 18.", "Use of this room is governed by house rules.",
    "The moon passed in front of the sun, an eclipse seen by the general public.", "He gave the engine a boost with new software.", "The warranty of this fridge covers two years.", "The court held that the author was liable for the damages.", "No animal was harmed in the making of this film.", "The authors of the study published their data in a journal.",
    "Conditions on the road were met with caution by the drivers.", "The Commission of the European Union met in public.", "The software crashed twice before the update was distributed.", "Everyone is permitted to bring one guest.", "Commercial applications of the method are in preparation.",
]
HELD_OUT_LOOKALIKES = [
    "The pilot lost his license after the accident.", "The Apache nation held its council in the mountains.", "Students at MIT built a small satellite.", "The public license office opens at nine.", "Her rights were violated, the court found.", "The general store sells books to the public.",
    "The warranty expired before the product was sold.", "We hope that it will be useful to our readers.", "The software company moved to a new building.", "A copy of the letter was sent to the mayor without delay.", "The village commons are open to all sheep.", "They provided an express train without any stops.",
    "Under the terms of the treaty the river is shared.", "The material is available in any form or color.", "He granted her permission to use the kitchen for any purpose.", "The eclipse will be visible from the public park.", "The source of the river lies in the hills.", "Reproduction of rabbits is fast.",
]
