"""Templates of license texts and notices, and the words by which they differ from their kin.

Whole texts are the files in ``license_files``.
"""

from pathlib import Path

# Published wordings.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS '
        "OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior "
        "written permission."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "GPL-3.0": "licensed under the GNU General Public License, version 3",
    "GPL-3.0 notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT": "Released under the MIT License",
    "MIT text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
}

# A name is given only if the first of each of these words in the template is matched too.
DISTINCT = {
    "Apache-2.0": "apache 2",
    "Apache-2.0 header": "apache 2",
    "CC-BY-4.0": "attribution 4",
    "CC-BY-NC-4.0": "by nc 4",
    "CC-BY-SA-4.0": "sharealike 4",
    "GPL-3.0": "general 3",
    "GPL-3.0 notice": "general 3",
    "MIT": "mit",
    "MPL-2.0": "mozilla 2",
}
# Between the matched words of a notice, these say that it is another one, unless the template has them too.
QUALIFIERS = frozenset(
    "lesser library affero noncommercial sharealike noderivatives noderivs nc sa nd mit apache bsd isc".split()
)


def _add(name: str, text: str, distinct: str) -> None:
    TEMPLATES[name] = text
    DISTINCT[name] = distinct


# Creative Commons: each kind and version in its long and its short form.
_KINDS = {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-NC": "Attribution-NonCommercial",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
for _kind, _long in _KINDS.items():
    for _version, _ported in (("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"), ("2.0", "Generic")):
        _name = f"CC-{_kind}-{_version}"
        # 2.0 and 2.5 differ in both digits, the others in the first.
        _digits = " ".join(_version.split(".")) if _version[0] == "2" else _version[0]
        _wording = _long if _version == "4.0" else _long.replace("NoDerivatives", "NoDerivs")
        _line = f"This work is licensed under a Creative Commons {_wording} {_version} {_ported} License"
        _short = f"Licensed under CC {_kind} {_version}"
        _line_name = f"{_name} line" if TEMPLATES.get(_name) == _short else _name
        _add(_line_name, _line, f"{_wording.replace('-', ' ').lower()} {_digits}")
        _add(_name if _line_name != _name else f"{_name} short", _short, f"cc {_kind.replace('-', ' ').lower()} {_digits}")
_add("CC0-1.0 short", "Released under CC0 1.0", "cc0 1")
_add("CC0-1.0 line", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "waived")

# GNU: each license and version in several forms.
_GNU = {
    "GPL": ("General Public License", "", ("1.0", "2.0", "3.0")),
    "LGPL": ("Lesser General Public License", "lesser", ("2.1", "3.0")),
    "LGPL old": ("Library General Public License", "library", ("2.0",)),
    "AGPL": ("Affero General Public License", "affero", ("3.0",)),
}
for _short, (_long, _word, _versions) in _GNU.items():
    _short = _short.split()[0]
    for _version in _versions:
        _name, _plain = f"{_short}-{_version}", _version.removesuffix(".0")
        _distinct = f"{_word} general {' '.join(_plain.split('.'))}"
        _add(_name, f"licensed under the GNU {_long}, version {_plain}", _distinct)
        _add(f"{_name} reversed", f"licensed under version {_plain} of the GNU {_long}", _distinct)
        _add(f"{_name} short", f"licensed under the {_short}v{_plain}", f"{_short}v{_plain}".lower().replace(".", " "))
        _add(f"{_name} spelt", f"licensed under the GNU {_short} {_version}", f"{_short} {' '.join(_version.split('.'))}".lower())
        if _name != "GPL-3.0":
            _notice = TEMPLATES["GPL-3.0 notice"].replace("General Public License", _long)
            _notice = _notice.replace("version 3", f"version {_plain}")
            _add(f"{_name} notice", _notice, _distinct)

_BSD = TEMPLATES["BSD-3-Clause"].split(" 3. Neither")[0]
TEMPLATES["BSD-2-Clause"] = _BSD
DISTINCT["BSD-3-Clause"] = "neither endorse"
_add("BSD-2-Clause line", "licensed under the BSD 2-Clause License", "bsd 2")
_add("BSD-3-Clause line", "licensed under the BSD 3-Clause License", "bsd 3")
_add("MIT line", "licensed under the MIT License", "mit")
_add("ISC line", "licensed under the ISC License", "isc")
_add("MPL-2.0 line", "licensed under the Mozilla Public License, version 2.0", "mozilla 2")
_add("MPL-1.1 line", "licensed under the Mozilla Public License, version 1.1", "mozilla 1")
for _version in ("1.0", "2.0"):
    _add(f"EPL-{_version}", f"licensed under the Eclipse Public License, version {_version}", f"eclipse {_version[0]}")
    _add(
        f"EPL-{_version} notice",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
        f"v{_version} which is available at https://www.eclipse.org/legal/epl-v{_version[0]}0",
        f"eclipse v{_version[0]}",
    )
_add(
    "Unlicense",
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
    "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
    "purpose, commercial or non-commercial, and by any means.",
    "unencumbered",
)
for _file in sorted((Path(__file__).parent / "license_files").glob("*.txt")):
    TEMPLATES[f"{_file.stem} text"] = _file.read_text(encoding="utf-8")
