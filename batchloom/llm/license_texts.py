"""What licenses say: short texts and file headers in full, and notices and tags made from names by rule."""

from __future__ import annotations

_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
    "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
    "included in all copies or substantial portions of the Software."
)
_MIT_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
    "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_CONDITIONS = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
    "reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior "
    "written permission."
)
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _gnu(name: str, version: str) -> str:
    """The header that the GNU licenses ask for."""
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, "
        f"either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        f"WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
    )


#: Texts of short licenses without their copyright line, and the headers that long ones ask for.
TEXTS = (
    ("Apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
     "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause-text", f"{_BSD_START} {_BSD_CONDITIONS} {_BSD_WARRANTY}"),
    ("BSD-3-Clause-text", f"{_BSD_START} {_BSD_CONDITIONS} {_BSD_NAMES} {_BSD_WARRANTY}"),
    ("BSL-1.0-text", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "
     "\"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is "
     "furnished to do so, all subject to the following:"),
    ("ISC-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
     "notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND "
     "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
     "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT-text", f"{_MIT_GRANT} {_MIT_WARRANTY}"),
    ("MPL-2.0-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
     "https://mozilla.org/MPL/2.0/."),
    ("Unlicense-text", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in "
     "source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("WTFPL-text", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."),
    ("Zlib-text", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
     "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
     "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product "
     "documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
     "This notice may not be removed or altered from any source distribution."),
    *((f"{spdx}-header", _gnu(name, version)) for spdx, name, version in (
        ("AGPL-3.0", "GNU Affero General Public License", "3"),
        ("GPL-2.0", "GNU General Public License", "2"),
        ("GPL-3.0", "GNU General Public License", "3"),
        ("LGPL-2.1", "GNU Lesser General Public License", "2.1"),
        ("LGPL-3.0", "GNU Lesser General Public License", "3"),
    )),
)

#: SPDX identifiers and the names that notices use.
NAMES = (
    ("0BSD", "the Zero-Clause BSD License"),
    ("AGPL-3.0", "the GNU Affero General Public License, version 3"),
    ("Apache-2.0", "the Apache License, Version 2.0"),
    ("Artistic-2.0", "the Artistic License 2.0"),
    ("BSD-2-Clause", "the BSD 2-Clause License"),
    ("BSD-3-Clause", "the BSD 3-Clause License"),
    ("BSL-1.0", "the Boost Software License, Version 1.0"),
    ("EPL-2.0", "the Eclipse Public License 2.0"),
    ("EUPL-1.2", "the European Union Public Licence 1.2"),
    ("GPL-2.0", "the GNU General Public License, version 2"),
    ("GPL-3.0", "the GNU General Public License, version 3"),
    ("ISC", "the ISC License"),
    ("LGPL-2.1", "the GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "the GNU Lesser General Public License, version 3"),
    ("MIT", "the MIT License"),
    ("MPL-2.0", "the Mozilla Public License, version 2.0"),
    ("ODbL-1.0", "the Open Database License"),
    ("OFL-1.1", "the SIL Open Font License, Version 1.1"),
    ("Unlicense", "the Unlicense"),
    ("WTFPL", "the WTFPL"),
    ("Zlib", "the zlib License"),
)
#: The parts of Creative Commons licenses, short and long.
CREATIVE_COMMONS = (
    ("BY", "Attribution"),
    ("BY-SA", "Attribution-ShareAlike"),
    ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC", "Attribution-NonCommercial"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
)
VERBS = ("licensed", "released", "distributed")


def _names() -> list[tuple[str, str]]:
    out = [*NAMES, ("CC0-1.0", "CC0 1.0"), ("CC0-1.0", "Creative Commons CC0 1.0")]
    for short, long in CREATIVE_COMMONS:
        for version, tail in (("4.0", " International"), ("3.0", " Unported")):
            spdx = f"CC-{short}-{version}"
            out += [(spdx, f"CC {short} {version}"), (spdx, f"a Creative Commons {long} {version}{tail}")]
    return out


def notices() -> list[tuple[str, str]]:
    """License and notice: tags, and what is said to be licensed, released or distributed under a name."""
    out = [("all-rights-reserved", "All rights reserved")]
    tags = sorted({spdx for spdx, _ in _names()})
    out += [(spdx, f"SPDX-License-Identifier: {spdx}") for spdx in tags]
    out += [(spdx, f"{verb} under {name}") for spdx, name in _names() for verb in VERBS]
    return out
