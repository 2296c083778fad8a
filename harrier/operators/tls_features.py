"""24 features of certificate chains, from decoded chains.

Input column: struct(protocol, cipher, count, certs), certs an array of struct(not_before, not_after, issuer_cn,
issuer_o, issuer_c, extensions array of (oid, critical), san_dns, san_count, eku, policies, is_ca), the leaf first.
Certificates after the first that was never valid or has expired by ``as_of`` aren't looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrier.functions.text import col, md5_mod

# Fixed values.
VERSIONS = {"TLSv1": 0, "TLSv1.1": 1, "TLSv1.2": 2, "TLSv1.3": 3}
CIPHERS = {
    "ECDHE-RSA-AES128-GCM-SHA256": 0,
    "TLS_AES_128_GCM_SHA256": 1,
    "TLS_AES_256_GCM_SHA384": 2,
    "ECDHE-ECDSA-CHACHA20-POLY1305": 3,
    "ECDHE-RSA-AES128-SHA": 3,
    "ECDHE-RSA-CHACHA20-POLY1305": 4,
    "ECDHE-RSA-AES256-GCM-SHA384": 5,
    "ECDHE-ECDSA-AES128-GCM-SHA256": 6,
    "TLS_CHACHA20_POLY1305_SHA256": 7,
    "ECDHE-ECDSA-AES256-GCM-SHA384": 8,
    "ECDHE-RSA-AES256-SHA384": 9,
    "AES128-SHA256": 10,
    "DHE-RSA-AES256-GCM-SHA384": 11,
    "AES256-SHA256": 12,
    "AES128-SHA": 13,
    "DHE-RSA-AES128-GCM-SHA256": 14,
}
SERVER_AUTH, CLIENT_AUTH = "1.3.6.1.5.5.7.3.1", "1.3.6.1.5.5.7.3.2"


def lookup(table: dict[str, int], key: Column, default: int) -> Column:
    pairs = F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def days(start: Column, end: Column) -> Column:
    """Days from start to end, to the nearest, halves to even."""
    return F.bround((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(86400e6))


def tls_features(df: DataFrame, tls: str = "tls", as_of: str | Column = "as_of") -> DataFrame:
    """df with the 24 features; without a chain all but tls_has_tls (false) are null."""
    chain, now = col(tls), col(as_of)
    certs = F.coalesce(chain["certs"], F.array().cast(df.schema[tls].dataType["certs"].dataType))
    broken = lambda c: days(c["not_before"], c["not_after"]) < 0
    expired = lambda c: days(now, c["not_after"]) < 0
    state = F.transform(certs, lambda c: F.when(broken(c), 1).when(expired(c), 2).otherwise(0))
    first = F.get(F.filter(F.transform(state, lambda s, i: F.when(s > 0, i + 1)), lambda i: i.isNotNull()), F.lit(0))
    out = df.withColumns({"__n": F.size(certs), "__at": first, "__stop": F.get(state, first - 1)})
    out = out.withColumn("__good", F.when(F.col("__at").isNull(), certs).otherwise(F.slice(certs, F.lit(1), F.greatest(F.col("__at") - 1, F.lit(0)))))
    good, n_good = F.col("__good"), F.size("__good")
    visited = F.coalesce("__at", "__n")
    leaf = F.get(good, F.lit(0))
    root = F.when((n_good == F.col("__n")) & (F.col("__n") >= 2), F.get(good, n_good - 1))
    # an array of its last place without nulls: the sum over certificates of a number
    add = lambda f, start=0: F.aggregate(good, F.lit(start), lambda a, c: a + F.coalesce(f(c), F.lit(0)))
    length = lambda c: F.coalesce(days(c["not_before"], c["not_after"]), F.lit(-1.0))
    policies = lambda prefix: add(lambda c: F.size(F.filter(F.coalesce(c["policies"], F.array().cast("array<string>")), lambda p: F.startswith(p, F.lit(prefix)))))
    uses = lambda oid: add(lambda c: F.size(F.filter(F.coalesce(c["eku"], F.array().cast("array<string>")), lambda u: u == oid)))
    with_policies = F.size(F.filter(good, lambda c: c["policies"].isNotNull()))
    sans = F.filter(good, lambda c: c["san_count"].isNotNull())
    names = F.array_distinct(F.filter(F.flatten(F.transform(sans, lambda c: F.coalesce(c["san_dns"], F.array().cast("array<string>")))), lambda x: F.length(x) >= 2))
    present = F.col("__n") > 0
    features = {
        "tls_chain_len": chain["count"].cast("long"),
        "tls_is_self_signed": F.lit(0).cast("long"),
        "tls_root_authority_hash": md5_mod(F.coalesce(root["issuer_o"], F.lit(""))),
        "tls_leaf_authority_hash": md5_mod(F.coalesce(leaf["issuer_o"], F.lit(""))),
        "tls_negotiated_version_id": lookup(VERSIONS, chain["protocol"], 0).cast("long"),
        "tls_negotiated_cipher_id": lookup(CIPHERS, chain["cipher"], 0).cast("long"),
        "tls_root_cert_validity_len": F.when(root.isNotNull(), length(root)).otherwise(-1.0),
        "tls_leaf_cert_validity_len": F.when(leaf.isNotNull(), length(leaf)).otherwise(-1.0),
        "tls_broken_chain": F.coalesce((F.col("__stop") == 1).cast("long"), F.lit(0).cast("long")),
        "tls_expired_chain": F.coalesce((F.col("__stop") == 2).cast("long"), F.lit(0).cast("long")),
        "tls_total_extension_count": add(lambda c: F.size(F.coalesce(c["extensions"], F.array())), -1).cast("long"),
        "tls_critical_extensions": add(lambda c: F.size(F.filter(c["extensions"], lambda e: e["critical"])), -1).cast("long"),
        "tls_with_policies_crt_count": with_policies.cast("long"),
        "tls_percentage_crt_with_policies": F.try_divide(with_policies.cast("double"), visited),
        "tls_x509_anypolicy_crt_count": F.lit(0).cast("long"),
        "tls_iso_policy_crt_count": policies("1.").cast("long"),
        "tls_joint_isoitu_policy_crt_count": policies("2.").cast("long"),
        "tls_subject_count": F.coalesce(F.get(sans, F.size(sans) - 1)["san_count"], F.lit(0)).cast("long"),
        "tls_server_auth_crt_count": uses(SERVER_AUTH).cast("long"),
        "tls_client_auth_crt_count": uses(CLIENT_AUTH).cast("long"),
        "tls_CA_certs_in_chain_ratio": F.try_divide(F.size(F.filter(good, lambda c: F.coalesce(c["is_ca"], F.lit(False)))).cast("double"), visited),
        "tls_unique_SLD_count": F.size(names).cast("long"),
        "tls_common_name_count": F.size(F.filter(good, lambda c: c["issuer_cn"].isNotNull())).cast("long"),
    }
    out = out.withColumns({"tls_has_tls": present, **{k: F.when(present, v) for k, v in features.items()}})
    return out.drop("__n", "__at", "__stop", "__good")
