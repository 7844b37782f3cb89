"""Which product an alert came from, and which policy it falls under."""

from pyspark.sql import DataFrame

from alertloom import constants as K
from alertloom.functions.coerce import add, any_word, case, lower_text, quoted_list

_HAS_DEVICE_DATA = "(coalesce(data.devid, '') <> '' OR coalesce(data.subtype, '') = 'ips')"


def _is_windows(haystack: str) -> str:
    return (f"(contains({haystack}, 'windows') OR contains(_dec, 'win') "
            "OR contains(_agent, 'win') OR coalesce(has_win_event, false))")


def with_signals(alerts: DataFrame) -> DataFrame:
    """Lower-case texts every later rule reads, computed once per row."""
    lowered = add(
        alerts,
        _dec=lower_text("decoder.name"),
        _groups="transform(coalesce(rule.groups, cast(array() AS array<string>)), "
                "g -> lower(g))",
        _agent=lower_text("agent.name"),
        _loc=lower_text("location"),
        _msg=lower_text("full_log"),
    )
    tagged = add(lowered, _tags="concat_ws(' ', _dec, array_join(_groups, ' '), _agent)")
    return add(tagged, _full="concat_ws(' ', _tags, _loc)")


def detect_source(signals: DataFrame) -> DataFrame:
    """Adds ``source``; the first matching rule wins, network appliances before anything else."""
    network = case(("contains(_full, 'fortigate')", "'fortigate'"),
                   ("contains(_full, 'cisco') OR contains(_full, 'asa')", "'cisco'"),
                   otherwise="'unifi'")
    linux = (f"_dec IN ({quoted_list(K.LINUX_DECODERS)}) OR _loc = 'journald' "
             f"OR {any_word('_dec', K.LINUX_DECODER_WORDS)} "
             f"OR {any_word('_full', K.LINUX_WORDS)} OR contains(_full, 'linux')")
    return add(signals, source=case(
        (any_word("_full", K.NETWORK_WORDS), network),
        (_HAS_DEVICE_DATA, "'fortigate'"),
        (_is_windows("_full"), "'windows'"),
        (any_word("_full", K.OPENSTACK_WORDS), "'openstack'"),
        (linux, "'linux'"),
        otherwise="'generic'",
    ))


def policy_source(signals: DataFrame) -> DataFrame:
    """Adds ``policy_source``: a separate rule order that does not look at the location."""
    return add(signals, policy_source=case(
        (any_word("_tags", K.NETWORK_WORDS), "'network'"),
        (_is_windows("_tags"), "'endpoint'"),
        ("contains(_tags, 'linux')", "'endpoint'"),
        (any_word("_tags", K.OPENSTACK_WORDS), "'server'"),
        (_HAS_DEVICE_DATA, "'network'"),
        otherwise="'server'",
    ))


def drop_signals(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if not c.startswith("_")])
