"""Services that tests inject into sources and ledgers."""

import json
import os
import uuid
from pathlib import Path

NEWEST = "/tmp/sievework-newest.json"


def set_newest(_, **channels):
    Path(NEWEST).write_text(json.dumps(channels))


def newest(channel):
    return json.loads(Path(NEWEST).read_text())[channel]


def page(channel, before):
    """Four messages before an id."""
    ids = range(max(1, before - 4), before)
    block = '<div class="js-widget_message_wrap"><div data-post="{}/{}"><div class="tgme_widget_message_text js-message_text" dir="auto">text {}</div></div></div>'
    return "".join(block.format(channel, i, i).replace('js-widget_message_wrap"', 'tgme_widget_message_wrap js-widget_message_wrap"') for i in ids)


def updates(offset):
    return [(i, "{}") for i in range(offset, 10)]


class Labeller:
    """Writes down each call; fails on texts that it doesn't like."""

    def __init__(self, log, bad):
        self.log, self.bad = log, bad

    def __call__(self, texts):
        Path(self.log, f"{os.getpid()}-{uuid.uuid4().hex}").write_text(",".join(texts))
        if self.bad & set(texts):
            raise ValueError("not this one")
        return f"{len(texts)} answers"
