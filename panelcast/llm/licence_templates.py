"""Public words by which licences are stated: short statements, identifiers, headers, titles, texts."""

from __future__ import annotations

# Name here, SPDX identifiers, usual full name.
NAMES = [
    ("AGPL-3.0", "AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later", "GNU Affero General Public License, version 3"),
    ("Apache-2.0", "Apache-2.0", "Apache License, Version 2.0"),
    ("BSD-2-Clause", "BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD-3-Clause", "BSD 3-Clause License"),
    ("BSL-1.0", "BSL-1.0", "Boost Software License, Version 1.0"),
    ("CC-BY-4.0", "CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-NC-4.0", "CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC0-1.0", "CC0-1.0", "CC0 1.0"),
    ("EPL-2.0", "EPL-2.0", "Eclipse Public License, version 2.0"),
    ("GPL-2.0", "GPL-2.0 GPL-2.0-only GPL-2.0-or-later", "GNU General Public License, version 2"),
    ("GPL-3.0", "GPL-3.0 GPL-3.0-only GPL-3.0-or-later", "GNU General Public License, version 3"),
    ("ISC", "ISC", "ISC License"),
    ("LGPL-2.1", "LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later", "GNU Lesser General Public License, version 3"),
    ("MIT", "MIT", "MIT License"),
    ("MPL-2.0", "MPL-2.0", "Mozilla Public License, version 2.0"),
    ("Unlicense", "Unlicense", "Unlicense"),
]

# Other usual names.
OTHER_NAMES = [
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "CC0 1.0 Universal Public Domain Dedication"),
    ("AGPL-3.0", "GNU Affero General Public License v3"),
    ("GPL-2.0", "GNU General Public License v2"),
    ("GPL-3.0", "GNU General Public License v3"),
    ("LGPL-2.1", "GNU Lesser General Public License v2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License v3"),
    ("AGPL-3.0", "AGPLv3"),
    ("GPL-2.0", "GPLv2"),
    ("GPL-3.0", "GPLv3"),
    ("LGPL-2.1", "LGPLv2.1"),
    ("LGPL-3.0", "LGPLv3"),
]

# Statements without a version; their licence is named without one.
UNVERSIONED = [
    ("AGPL", "GNU Affero General Public License"),
    ("Apache", "Apache License"),
    ("GPL", "GNU General Public License"),
    ("LGPL", "GNU Lesser General Public License"),
    ("MPL", "Mozilla Public License"),
]

GNU_HEADER = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the "
    "GNU {kind} as published by the Free Software Foundation, either version {version} of the License, or "
    "(at your option) any later version."
)
GNU_ONLY_HEADER = (
    "This program is free software; you can redistribute it and/or modify it under the terms of the "
    "GNU {kind} version {version} as published by the Free Software Foundation."
)
GNU_WARRANTY = (
    " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
    "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} "
    "for more details. You should have received a copy of the GNU {kind} along with this program. If "
    "not, see http://www.gnu.org/licenses"
)
GNU_KINDS = [
    ("AGPL-3.0", "Affero General Public License", "3"),
    ("GPL-2.0", "General Public License", "2"),
    ("GPL-3.0", "General Public License", "3"),
    ("LGPL-2.1", "Lesser General Public License", "2.1"),
    ("LGPL-3.0", "Lesser General Public License", "3"),
]

BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met: Redistributions of source code must retain the "
    "above copyright notice, this list of conditions and the following disclaimer. Redistributions in "
    "binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution."
)
BSD_THIRD = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
    "or promote products derived from this software without specific prior written permission."
)
BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR '
    "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
    "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
    "POSSIBILITY OF SUCH DAMAGE."
)
MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    'associated documentation files (the "Software"), to deal in the Software without restriction, '
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions:"
)
MIT_REST = (
    " The above copyright notice and this permission notice shall be included in all copies or substantial "
    'portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR '
    "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
APACHE_HEADER = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
    "compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0"
)
APACHE_REST = (
    " Unless required by applicable law or agreed to in writing, software distributed under the License "
    'is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or '
    "implied. See the License for the specific language governing permissions and limitations under the License."
)

# Headers, titles of full texts and short full texts.
PASSAGES = [
    ("Apache-2.0", APACHE_HEADER),
    ("Apache-2.0", APACHE_HEADER + APACHE_REST),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("BSD-2-Clause", f"{BSD_TWO} {BSD_WARRANTY}"),
    ("BSD-3-Clause", f"{BSD_TWO} {BSD_THIRD} {BSD_WARRANTY}"),
    ("BSD-3-Clause", BSD_THIRD),
    (
        "BSL-1.0",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file "
        "LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    ),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("CC-BY-4.0", "Attribution 4.0 International Creative Commons"),
    ("CC-BY-NC-4.0", "Attribution-NonCommercial 4.0 International Creative Commons"),
    ("CC-BY-SA-4.0", "Attribution-ShareAlike 4.0 International Creative Commons"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    (
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse "
        "Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
        "is hereby granted, provided that the above copyright notice and this permission notice appear in all "
        "copies.",
    ),
    ("MIT", MIT_GRANT),
    ("MIT", MIT_GRANT + MIT_REST),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of "
        "the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def _all() -> list[tuple[str, str]]:
    found = []
    for name, identifiers, full in NAMES:
        the = "" if full.startswith("CC") else "the "
        found += [(name, f"{verb} under {the}{full}.") for verb in ("Licensed", "Released")]
        found.append((name, f"This work is licensed under {the}{full}."))
        found += [(name, f"SPDX-License-Identifier: {i}") for i in identifiers.split()]
    found += [(name, f"This work is licensed under a {full}.") for name, full in OTHER_NAMES[:4]]
    found += [(name, f"Licensed under the {full}.") for name, full in OTHER_NAMES[4:]]
    for name, full in UNVERSIONED:
        found += [(name, f"{verb} under the {full}.") for verb in ("Licensed", "Released")]
    for name, kind, version in GNU_KINDS:
        parts = {"kind": kind, "version": version}
        found.append((name, GNU_HEADER.format(**parts)))
        found.append((name, (GNU_HEADER + GNU_WARRANTY).format(**parts)))
        found.append((name, GNU_ONLY_HEADER.format(**parts)))
    return found + PASSAGES


TEMPLATES = _all()
