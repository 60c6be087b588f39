"""The genotyping queries in DuckDB's SQL, written on their own: one chain of tables, of which each query reads one."""

from __future__ import annotations

U, M = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACCTTGGAACCTTGGAACCTTGGAAC"


def _rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


def _canon(x: str) -> str:
    return f"least({x}, {_rc(x)})"


def _fits(mask: str, flank: str) -> str:
    """The mask's middle 24 bases, in order, with gaps, as a LIKE pattern."""
    like = lambda m: f"({flank} LIKE '%' || regexp_replace(substr({m}, 5, 24), '(.)', '\\1%', 'g'))"
    return f"coalesce({like(mask)} OR {like(_rc(mask))}, false)"


G = "['0/0', '0/1', '1/0', '1/1']"
LOG = "(-(ln(spread) + 0.5 * (ln(2.0::DOUBLE) + ln(3.141592653589793::DOUBLE))) - 0.5 * (x - mean) * (x - mean) / spread)"

CHAIN = rf"""
WITH RECURSIVE dna AS (SELECT doc_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{U}', '{M}') AS seq FROM documents WHERE text IS NOT NULL),
placed AS (SELECT doc_id, seq, 'chr' || (1 + doc_id % 22) AS chrom, coalesce(sum(len(seq)) OVER (PARTITION BY doc_id % 22 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM dna),
reference AS (SELECT chrom, string_agg(seq, '' ORDER BY doc_id) AS seq FROM placed GROUP BY chrom),
reads AS (
  SELECT doc_id * 1000000 + o AS read_id, (o // 30) % 2 AS sample, substr(seq, o + 1, 150) AS seq
  FROM (SELECT doc_id, seq, unnest(list_distinct(range(0, greatest(len(seq) - 150, 0) + 1, 30) || [greatest(len(seq) - 150, 0)])) AS o FROM dna) WHERE len(substr(seq, o + 1, 150)) >= 32),
read_windows AS (SELECT seq, unnest(range(0, len(seq) - 31)) AS s FROM reads),
read_kmers AS (SELECT {_canon("substr(seq, s + 1, 32)")} AS kmer FROM read_windows),
counts AS (SELECT kmer, count(*) AS total FROM read_kmers GROUP BY kmer),
chunks AS (
  SELECT chrom, n, off, base, substr(seq, base + 1, 1792) AS seq
  FROM (SELECT chrom, seq, len(seq) AS n, c * 1024 AS off, greatest(c * 1024 - 256, 0) AS base FROM (SELECT *, unnest(range(0, len(seq) // 1024 + 1)) AS c FROM reference))),
ref_starts AS (SELECT chrom, n, seq, pos, pos - base AS i FROM (SELECT *, unnest(range(greatest(234, off), least(n - 500, off + 1024))) AS pos FROM chunks WHERE n > 734)),
ref_kmers AS (SELECT chrom, n, seq, pos, i, {_canon("substr(seq, i + 1, 32)")} AS kmer FROM ref_starts),
panel_97 AS (SELECT * FROM ref_kmers WHERE (pos - 234) % 97 = 0),
panel_61 AS (SELECT * FROM ref_kmers WHERE (pos - 234) % 61 = 0),
depth_panel AS (SELECT DISTINCT kmer FROM panel_97),
gc_panel AS (SELECT kmer, min(len(regexp_replace(substr(seq, i - 233, 500), '[^CG]', '', 'g')) // 5) AS gc FROM panel_61 GROUP BY kmer),
panel_counts AS (SELECT kmer, CAST(coalesce(total, 0) AS BIGINT) AS total FROM depth_panel LEFT JOIN counts USING (kmer)),
gc_counts AS (SELECT gc, CAST(coalesce(total, 0) AS BIGINT) AS total FROM gc_panel LEFT JOIN counts USING (kmer)),
trims AS (
  SELECT 1 AS round, CAST(1e18 AS DOUBLE) AS cut, (SELECT CAST(sum(total) AS BIGINT) // count(*) FROM panel_counts) AS mean
  UNION ALL
  SELECT round + 1, mean + 3 * std, after FROM (
    SELECT t.round, t.mean, s.std, (SELECT CAST(sum(total) AS BIGINT) // count(*) FROM panel_counts WHERE total <= t.cut AND total <= t.mean + 3 * s.std) AS after
    FROM trims t, LATERAL (SELECT sqrt(sum(pow(total - t.mean, 2)) / count(*)) AS std FROM panel_counts WHERE total <= t.cut) s) WHERE after <> mean),
settled AS (
  SELECT mean AS coverage, (SELECT sqrt(sum(pow(total - t.mean, 2)) / count(*)) FROM panel_counts WHERE total <= t.cut) AS std, round AS rounds FROM trims t ORDER BY round DESC LIMIT 1),
gc_trims AS (
  SELECT gc, 1 AS round, CAST(1e18 AS DOUBLE) AS cut, CAST(sum(total) AS BIGINT) // count(*) AS mean FROM gc_counts GROUP BY gc
  UNION ALL
  SELECT gc, round + 1, mean + 3 * std, after FROM (
    SELECT t.gc, t.round, t.mean, s.std, (SELECT CAST(sum(total) AS BIGINT) // count(*) FROM gc_counts c WHERE c.gc = t.gc AND total <= t.cut AND total <= t.mean + 3 * s.std) AS after
    FROM gc_trims t, LATERAL (SELECT sqrt(sum(pow(total - t.mean, 2)) / count(*)) AS std FROM gc_counts c WHERE c.gc = t.gc AND total <= t.cut) s) WHERE after <> mean),
gc_depth AS (
  SELECT CAST(g AS INTEGER) AS gc, CASE WHEN mean IS NULL THEN coverage::DOUBLE ELSE greatest(0.2::DOUBLE * coverage, mean::DOUBLE) END AS depth
  FROM (SELECT unnest(range(0, 101)) AS g) LEFT JOIN (SELECT gc, arg_max(mean, round) AS mean FROM gc_trims GROUP BY gc) ON g = gc, settled),
items AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS k, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{U}', '{M}') AS ins FROM benchmark WHERE text IS NOT NULL),
drawn AS (
  SELECT p_partkey, chrom, CAST(300 + (p_partkey * 7919) % (len(seq) - 1100) AS INTEGER) AS b, CAST(40 + p_size * 4 AS INTEGER) AS size, ['DEL', 'INS', 'INV'][CAST(p_partkey % 3 + 1 AS BIGINT)] AS svtype, ins
  FROM part JOIN reference ON chrom = 'chr' || (1 + p_partkey % 22) JOIN items ON k = p_partkey % (SELECT count(*) FROM items) WHERE len(seq) > 1200),
ended AS (SELECT *, b + CASE WHEN svtype = 'INS' THEN 1 ELSE size END AS e, CASE WHEN svtype = 'INS' THEN substr(ins, 1, size) END AS seq FROM drawn),
tracks AS (
  SELECT CASE WHEN svtype <> 'INV' THEN svtype || '@' ELSE '' END || chrom || '_' || b || '_' || e AS track, chrom, b, e, svtype, CAST(coalesce(len(seq), size) AS INTEGER) AS svlen, seq, {G}[CAST(p_partkey % 4 + 1 AS BIGINT)] AS genotype, p_partkey AS partkey
  FROM ended QUALIFY row_number() OVER (PARTITION BY chrom, b, e, svtype ORDER BY p_partkey) = 1),
sample_genotypes AS (SELECT sample, track, {G}[CAST((partkey + sample) % 4 + 1 AS BIGINT)] AS genotype FROM tracks, (SELECT unnest([0, 1]) AS sample)),
del_windows AS (SELECT track, substr(r.seq, b - 31, svlen + 64) AS w FROM tracks t JOIN reference r USING (chrom) WHERE svtype = 'DEL'),
del_kmers AS (SELECT track, {_canon("substr(w, s + 1, 32)")} AS kmer, count(*) AS mult FROM (SELECT track, w, unnest(range(0, len(w) - 31)) AS s FROM del_windows) GROUP BY ALL),
brk_windows AS (SELECT track, substr(r.seq, b - 31, 64) AS w FROM tracks t JOIN reference r USING (chrom) WHERE svtype = 'INS'),
brk_kmers AS (SELECT track, {_canon("substr(w, s + 1, 32)")} AS kmer, count(*) AS mult FROM (SELECT track, w, unnest(range(0, len(w) - 31)) AS s FROM brk_windows) GROUP BY ALL),
ins_windows AS (SELECT track, chrom, b, substr(r.seq, b - 249, 250) || t.seq || substr(r.seq, e + 1, 250) AS w FROM tracks t JOIN reference r USING (chrom) WHERE svtype = 'INS'),
ins_body AS (
  SELECT track, chrom, b, s, {_canon("substr(w, s + 1, 32)")} AS kmer, substr(w, s - 31, 32) AS "left", CASE WHEN s + 64 <= len(w) THEN substr(w, s + 33, 32) END AS "right",
         CAST(len(regexp_replace(substr(w, s - 233, 500), '[^CG]', '', 'g')) // 5 AS INTEGER) AS gc
  FROM (SELECT *, unnest(range(282, CASE WHEN len(w) = 595 THEN 283 ELSE len(w) - 313 END)) AS s FROM ins_windows)),
ins_loci AS (
  SELECT n.* FROM (SELECT *, row_number() OVER (PARTITION BY track, kmer ORDER BY s) AS nth FROM ins_body) n LEFT JOIN brk_kmers k USING (track, kmer) WHERE nth > 1 OR k.kmer IS NULL),
ins_kmers AS (
  SELECT track, kmer, count(*) AS mult FROM ins_loci GROUP BY ALL
  UNION ALL SELECT track, kmer, mult FROM brk_kmers k WHERE NOT EXISTS (SELECT 1 FROM ins_body i WHERE i.track = k.track AND i.kmer = k.kmer)),
own AS (SELECT d.*, chrom, b, e FROM del_kmers d JOIN tracks USING (track)),
located AS (
  SELECT kmer, chrom, pos, CASE WHEN pos >= 32 THEN substr(seq, i - 31, 32) END AS "left", CASE WHEN pos + 64 <= n THEN substr(seq, i + 33, 32) END AS "right",
         CAST(len(regexp_replace(substr(seq, i - 233, 500), '[^CG]', '', 'g')) // 5 AS INTEGER) AS gc
  FROM (SELECT *, row_number() OVER (PARTITION BY kmer, chrom ORDER BY pos) AS nth FROM ref_kmers WHERE kmer IN (SELECT kmer FROM own)) WHERE nth <= 4),
hits AS (SELECT kmer, count(pos) AS hits FROM (SELECT DISTINCT kmer FROM own) LEFT JOIN located USING (kmer) GROUP BY kmer),
named AS (
  SELECT l.*, CASE WHEN EXISTS (SELECT 1 FROM own o WHERE o.kmer = l.kmer AND o.chrom = l.chrom AND l.pos >= o.b - 32 AND l.pos <= o.e) THEN 'INNER' ELSE 'REF' END AS type
  FROM located l JOIN hits USING (kmer) WHERE hits <= 3),
masks AS (SELECT DISTINCT kmer, mask FROM (SELECT kmer, unnest(["left", "right"]) AS mask FROM named WHERE type <> 'REF') WHERE mask IS NOT NULL),
aligned AS (
  SELECT (o // 30) % 2 AS sample, doc_id * 1000000 + o AS read_id, chrom, CAST(off + o AS INTEGER) AS pos, (doc_id + o // 30) % 5 AS kind, substr(seq, o + 1, 150) AS read
  FROM (SELECT *, unnest(list_distinct(range(0, len(seq) - 149, 30) || [len(seq) - 150])) AS o FROM placed WHERE len(seq) >= 150)),
near AS (SELECT sample, read_id, a.chrom, b, track, read, kind, svlen FROM aligned a JOIN tracks t ON a.chrom = t.chrom AND a.pos >= t.b - 100 AND a.pos <= t.e + 100),
clip AS (
  SELECT *, CASE kind WHEN 1 THEN [[0, 60]] WHEN 2 THEN [[90, 150]] WHEN 3 THEN [[0, 20], [130, 150]] WHEN 4 THEN CASE WHEN 140 >= 0.9 * svlen AND 140 <= 1.1 * svlen THEN [[50, 190]] ELSE [] END ELSE [] END AS clips FROM near),
across_all AS (
  SELECT sample, track, read_id, s, {_canon("substr(read, s + 1, 32)")} AS kmer, CASE WHEN s >= 32 THEN substr(read, s - 31, 32) END AS "left", CASE WHEN s + 64 <= 150 THEN substr(read, s + 33, 32) END AS "right"
  FROM (SELECT *, unnest(range(0, 119)) AS s FROM clip WHERE kind <> 3 AND len(clips) > 0)
  WHERE least(clips[1][2], s + 32) - greatest(clips[1][1], s) >= 10 AND substr(read, s + 1, 32) <> repeat('A', 32)),
across AS (
  SELECT sample, track, kmer, arg_min("left", (read_id, s)) FILTER ("left" IS NOT NULL) AS "left", arg_min("right", (read_id, s)) FILTER ("right" IS NOT NULL) AS "right" FROM across_all GROUP BY ALL),
carried AS (SELECT *, coalesce(genotype LIKE '%1%', false) AS carrier FROM across LEFT JOIN sample_genotypes USING (sample, track)),
witnesses AS (
  SELECT track, kmer, arg_min("left", sample) FILTER (carrier AND "left" IS NOT NULL) AS "left_any", "lf", "rf" FROM (
    SELECT track, kmer, sample, carrier, "left", first_value("left") OVER w AS lf, first_value("right") OVER w AS rf, count(DISTINCT sample) FILTER (carrier) OVER (PARTITION BY track, kmer) AS present, bool_or(NOT carrier) OVER (PARTITION BY track, kmer) AS absent
    FROM carried WINDOW w AS (PARTITION BY track, kmer ORDER BY carrier DESC, sample)) JOIN (SELECT track, count(*) AS carriers FROM sample_genotypes WHERE genotype LIKE '%1%' GROUP BY track) USING (track)
  WHERE present = carriers AND NOT absent GROUP BY track, kmer, lf, rf),
fit AS (SELECT DISTINCT o.* FROM own o JOIN (SELECT DISTINCT kmer FROM named) USING (kmer)),
first_locus AS (
  SELECT f.kmer, f.track, n.gc, g.depth FROM fit f JOIN named n ON n.kmer = f.kmer AND n.chrom = f.chrom AND n.type = 'INNER' AND n.pos >= f.b - 32 AND n.pos <= f.e JOIN gc_depth g ON g.gc = n.gc
  QUALIFY row_number() OVER (PARTITION BY f.kmer, f.track ORDER BY n.chrom, n.pos) = 1),
refs AS (SELECT kmer, count(*) AS ref FROM named WHERE type = 'REF' GROUP BY kmer),
numbered AS (SELECT kmer, track, row_number() OVER (PARTITION BY kmer ORDER BY track) AS nth, count(*) OVER (PARTITION BY kmer) AS n_tracks FROM fit),
single_combos AS (SELECT kmer, track, c AS combo, c AS g FROM numbered, (SELECT unnest([0, 1, 2]) AS c)),
joint_combos AS (SELECT kmer, track, combo, CAST(combo // CAST(pow(3, n_tracks - nth) AS BIGINT) % 3 AS BIGINT) AS g FROM (SELECT *, unnest(range(0, CAST(pow(3, n_tracks) AS BIGINT))) AS combo FROM numbered WHERE n_tracks <= 2)),
"""


def _lls(combos: str) -> str:
    return f"""ll_{combos} AS (
  SELECT kmer, combo, CASE WHEN spread > 0 THEN {LOG} END AS ll FROM (
    SELECT c.kmer, combo, sum((1 - g / 2.0::DOUBLE) * depth) + coalesce(any_value(ref), 0) * any_value(coverage)::DOUBLE AS mean,
           sum(0.25::DOUBLE / CASE g WHEN 0 THEN 0.25::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END * std) + coalesce(any_value(ref), 0) * any_value(std) AS spread,
           least(coalesce(any_value(total), 0), floor(sum(depth) + coalesce(any_value(ref), 0) * any_value(coverage)))::DOUBLE AS x
    FROM {combos} c LEFT JOIN first_locus f USING (kmer, track) LEFT JOIN refs r ON r.kmer = c.kmer LEFT JOIN counts n ON n.kmer = c.kmer, settled
    GROUP BY c.kmer, combo HAVING bool_and(depth IS NOT NULL))),
"""


def _places(name: str, own: str, more: str, most: str) -> str:
    """{name}_found (all places of the k-mers of own, and those of more), {name}_few (without k-mers of over `most` places in the reference), {name}_split (with their state) and {name}_verdict of junction k-mers."""
    return f"""
{name}_located AS (
  SELECT kmer, chrom, pos, CASE WHEN pos >= 32 THEN substr(seq, i - 31, 32) END AS "left", CASE WHEN pos + 64 <= n THEN substr(seq, i + 33, 32) END AS "right",
         CAST(len(regexp_replace(substr(seq, i - 233, 500), '[^CG]', '', 'g')) // 5 AS INTEGER) AS gc
  FROM (SELECT *, row_number() OVER (PARTITION BY kmer, chrom ORDER BY pos) AS nth FROM ref_kmers WHERE kmer IN (SELECT kmer FROM {own})) WHERE nth <= 4),
{name}_inside AS (SELECT DISTINCT l.kmer, l.chrom, l.pos FROM {name}_located l JOIN {own} o ON o.kmer = l.kmer AND o.chrom = l.chrom AND l.pos >= o.b - 32 AND l.pos <= o.e),
{name}_found AS (
  SELECT l.kmer, l.chrom, l.pos, CASE WHEN n.kmer IS NULL THEN 'REF' ELSE 'INNER' END AS type, "left", "right", gc, false AS trend FROM {name}_located l LEFT JOIN {name}_inside n ON n.kmer = l.kmer AND n.chrom = l.chrom AND n.pos = l.pos
  UNION ALL SELECT kmer, chrom, pos, type, "left", "right", gc, true FROM {more}),
{name}_few AS (SELECT row_number() OVER () AS place, * FROM {name}_found WHERE kmer NOT IN (SELECT kmer FROM {name}_found WHERE NOT trend GROUP BY kmer HAVING count(*) > {most})),
{name}_masks AS (SELECT DISTINCT kmer, mask FROM (SELECT kmer, unnest(["left", "right"]) AS mask FROM {name}_few WHERE type <> 'REF') WHERE mask IS NOT NULL),
{name}_shares AS (SELECT DISTINCT place FROM {name}_few f JOIN {name}_masks m USING (kmer) WHERE type = 'REF' AND ({_fits('f."left"', "m.mask")} OR {_fits('f."right"', "m.mask")})),
{name}_split AS (SELECT f.*, CASE WHEN type = 'REF' AND s.place IS NULL THEN 'filtered' ELSE 'active' END AS state FROM {name}_few f LEFT JOIN {name}_shares s USING (place)),
{name}_verdict AS (
  SELECT kmer, CASE WHEN bool_or(state = 'active' AND ("left" IS NULL OR "right" IS NULL)) AND bool_or(state = 'filtered') THEN CASE WHEN bool_or(state = 'active' AND type = 'REF') THEN 'drop' ELSE 'inverse' END ELSE 'keep' END AS verdict
  FROM {name}_split GROUP BY kmer),
"""


CHAIN += """
named_witnesses AS (SELECT w.track, kmer, lf AS "left", rf AS "right", chrom, b, e FROM witnesses w JOIN tracks USING (track)),
witness_places AS (SELECT kmer, chrom, b AS pos, 'JUNCTION' AS type, "left", "right", 0 AS gc FROM named_witnesses),
"""
CHAIN += _places("w", "named_witnesses", "witness_places", "1000000")
CHAIN += """
inner_own AS (SELECT track, kmer, mult FROM del_kmers UNION ALL SELECT track, kmer, mult FROM ins_kmers),
both_sides AS (SELECT DISTINCT kmer FROM inner_own WHERE kmer IN (SELECT kmer FROM named_witnesses)),
panel_own AS (
  SELECT track, kmer, mult, type, chrom, b, e FROM (SELECT track, kmer, mult, 'INNER' AS type FROM inner_own UNION ALL SELECT track, kmer, 1, 'JUNCTION' FROM named_witnesses) JOIN tracks t USING (track) WHERE kmer NOT IN (SELECT kmer FROM both_sides)),
panel_places AS (
  SELECT * FROM (SELECT kmer, chrom, b AS pos, 'INNER' AS type, "left", "right", gc FROM ins_loci UNION ALL SELECT kmer, chrom, pos, type, "left", "right", gc FROM witness_places) WHERE kmer NOT IN (SELECT kmer FROM both_sides)),
"""
CHAIN = CHAIN.replace("JOIN tracks t USING (track) WHERE kmer NOT IN", "JOIN (SELECT track, chrom, b, e FROM tracks) USING (track) WHERE kmer NOT IN")
CHAIN += _places("p", "panel_own", "panel_places", "3")
CHAIN += f"""
kinds AS (SELECT kmer, min(type) AS kind FROM panel_own GROUP BY kmer),
judged AS (
  SELECT s.*, kind, coalesce(kind = 'JUNCTION' AND verdict = 'inverse', false) AS inverse FROM p_split s JOIN kinds USING (kmer) LEFT JOIN p_verdict v USING (kmer) WHERE kind <> 'JUNCTION' OR verdict IS NULL OR verdict <> 'drop'),
panel_loci AS (
  SELECT kmer, chrom, pos, CASE WHEN inverse THEN 'REF' ELSE type END AS type, "left", "right", gc, trend FROM judged WHERE (NOT inverse AND state = 'active') OR (inverse AND type <> 'JUNCTION')),
panel_named AS (SELECT kmer FROM panel_loci WHERE type <> 'REF' UNION SELECT kmer FROM judged WHERE inverse),
panel_kmers AS (SELECT kmer, kind AS type, bool_or(inverse) AS inverse FROM judged WHERE kmer IN (SELECT kmer FROM panel_named) GROUP BY kmer, kind),
panel_tracks AS (SELECT * FROM panel_own WHERE kmer IN (SELECT kmer FROM panel_named)),
panel_masks AS (
  SELECT kmer, mask, '%' || regexp_replace(substr(mask, 5, 24), '(.)', '\\1%', 'g') AS ahead, '%' || regexp_replace(substr({_rc("mask")}, 5, 24), '(.)', '\\1%', 'g') AS back
  FROM (SELECT DISTINCT kmer, mask FROM (SELECT kmer, unnest(["left", "right"]) AS mask FROM panel_loci WHERE kmer IN (SELECT kmer FROM panel_named)) WHERE mask IS NOT NULL)),
met AS (
  SELECT row_number() OVER () AS m, * FROM (
    SELECT kmer, lf, rf, count(*) AS n FROM (
      SELECT {_canon("substr(seq, s + 1, 32)")} AS kmer, CASE WHEN s >= 32 THEN substr(seq, s - 31, 32) END AS lf, CASE WHEN s + 64 <= len(seq) THEN substr(seq, s + 33, 32) END AS rf FROM read_windows)
    WHERE kmer IN (SELECT kmer FROM panel_kmers) GROUP BY ALL)),
judged_met AS (SELECT m, bool_or(coalesce(lf LIKE ahead OR lf LIKE back, false) OR coalesce(rf LIKE ahead OR rf LIKE back, false)) AS fits FROM met JOIN panel_masks USING (kmer) GROUP BY m),
panel_seen AS (
  SELECT kmer, type, inverse, coalesce(sum(n) FILTER (fits IS NULL OR fits), 0) AS count, coalesce(sum(n), 0) AS total
  FROM panel_kmers LEFT JOIN met USING (kmer) LEFT JOIN judged_met USING (m) GROUP BY ALL),
panel_first AS (
  SELECT o.kmer, o.track, l.trend, g.depth FROM (SELECT DISTINCT kmer, track, chrom, b, e FROM panel_tracks) o JOIN panel_kmers k USING (kmer) JOIN panel_loci l ON l.kmer = o.kmer AND l.chrom = o.chrom AND l.type = k.type
    AND CASE WHEN k.type = 'JUNCTION' THEN l.pos = o.b ELSE l.pos >= o.b - 32 AND l.pos <= o.e END LEFT JOIN gc_depth g ON g.gc = l.gc
  QUALIFY row_number() OVER (PARTITION BY o.kmer, o.track ORDER BY CASE WHEN l.trend THEN 0 ELSE 1 END, l.chrom, l.pos) = 1),
panel_refs AS (SELECT kmer, count(*) AS ref FROM panel_loci JOIN panel_kmers k USING (kmer) WHERE panel_loci.type = 'REF' AND NOT inverse GROUP BY kmer),
"""


def _panel_lls(name: str, combos: str) -> str:
    """{name}_lls (kmer, combo, ll) of combos (kmer, track, combo, g): the likelihood of k-mers of all types, counted with masks."""
    return f"""{name}_terms AS (
  SELECT c.kmer, combo, k.inverse, inverse OR f.kmer IS NOT NULL AS known, coalesce(inverse OR k.type = 'JUNCTION', false) AS whole, f.trend, f.depth, g / 2.0::DOUBLE AS share,
         CASE g WHEN 0 THEN 0.25::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS wide
  FROM {combos} c JOIN panel_kmers k USING (kmer) LEFT JOIN panel_first f ON f.kmer = c.kmer AND f.track = c.track),
{name}_lls AS (
  SELECT kmer, combo, CASE WHEN spread > 0 THEN {LOG} END AS ll FROM (
    SELECT t.kmer, combo, sum(CASE WHEN whole THEN share * coverage WHEN NOT trend THEN (1 - share) * depth ELSE share * depth END) + coalesce(any_value(ref), 0) * any_value(coverage)::DOUBLE AS mean,
           sum(CASE WHEN NOT whole AND NOT trend THEN 0.25::DOUBLE / wide * std ELSE wide * std END) + coalesce(any_value(ref), 0) * any_value(std) AS spread,
           least(any_value(CASE WHEN t.inverse THEN total - count ELSE count END), floor(sum(CASE WHEN whole THEN coverage::DOUBLE ELSE depth END) + coalesce(any_value(ref), 0) * any_value(coverage)))::DOUBLE AS x
    FROM {name}_terms t JOIN panel_seen s ON s.kmer = t.kmer LEFT JOIN panel_refs r ON r.kmer = t.kmer, settled GROUP BY t.kmer, combo HAVING bool_and(known))),
"""


CHAIN += _panel_lls("panel", "(SELECT DISTINCT kmer, track, combo, combo AS g FROM panel_tracks, (SELECT unnest([0, 1, 2]) AS combo))")
CHAIN += """
panel_fit AS (
  SELECT * FROM panel_tracks WHERE kmer IN (SELECT kmer FROM panel_loci GROUP BY kmer HAVING count(*) <= 3) AND kmer IN (SELECT kmer FROM panel_tracks GROUP BY kmer HAVING count(DISTINCT track) <= 2 AND max(mult) <= 1)),
panel_numbered AS (SELECT kmer, track, row_number() OVER (PARTITION BY kmer ORDER BY track) AS nth, count(*) OVER (PARTITION BY kmer) AS n_tracks FROM (SELECT DISTINCT kmer, track FROM panel_fit)),
panel_combos AS (SELECT kmer, track, combo, CAST(combo // CAST(pow(3, n_tracks - nth) AS BIGINT) % 3 AS BIGINT) AS g FROM (SELECT *, unnest(range(0, CAST(pow(3, n_tracks) AS BIGINT))) AS combo FROM panel_numbered)),
"""
CHAIN += _panel_lls("joint_panel", "panel_combos")
CHAIN += """
panel_best AS (SELECT kmer, combo FROM joint_panel_lls WHERE ll > -100000 QUALIFY row_number() OVER (PARTITION BY kmer ORDER BY ll DESC, combo) = 1),
panel_agrees AS (
  SELECT kmer FROM panel_best JOIN panel_combos USING (kmer, combo) LEFT JOIN (SELECT track, genotype FROM tracks) USING (track) GROUP BY kmer HAVING bool_and((g > 0) = coalesce(genotype LIKE '%1%', false))),
panel_chosen AS (SELECT DISTINCT kmer, track, count(*) OVER (PARTITION BY kmer) AS n FROM (SELECT DISTINCT kmer, track FROM panel_fit WHERE kmer IN (SELECT kmer FROM panel_agrees))),
"""
CHAIN += _lls("single_combos") + _lls("joint_combos")
CHAIN += """
best AS (SELECT kmer, combo, ll FROM ll_joint_combos WHERE ll > -100000 QUALIFY row_number() OVER (PARTITION BY kmer ORDER BY ll DESC, combo) = 1),
links AS (SELECT DISTINCT x.track AS a, y.track AS b FROM {own} x JOIN {own} y USING (kmer) WHERE x.track <> y.track),
reach AS (SELECT DISTINCT track AS a, track AS b FROM {own} UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
clusters AS (SELECT a AS track, min(b) AS cluster FROM reach GROUP BY a),
alone AS (SELECT track, count(*) OVER (PARTITION BY cluster) = 1 AS alone FROM clusters),
sums AS (SELECT track, sum(ll) FILTER (combo = 0) AS l0, sum(ll) FILTER (combo = 1) AS l1, sum(ll) FILTER (combo = 2) AS l2 FROM (SELECT DISTINCT kmer, track FROM fit) JOIN ll_single_combos USING (kmer) GROUP BY track),
panel_sums AS (SELECT track, sum(ll) FILTER (combo = 0) AS l0, sum(ll) FILTER (combo = 1) AS l1, sum(ll) FILTER (combo = 2) AS l2 FROM (SELECT DISTINCT kmer, track FROM panel_tracks) JOIN panel_lls USING (kmer) GROUP BY track),
choice AS (SELECT *, CASE WHEN l1 > l0 OR l0 > 0 THEN l1 ELSE l0 END AS so_far, l1 > l0 OR l0 > 0 AS second FROM {sums}),
calls AS (SELECT track, CASE WHEN NOT alone THEN 0.0::DOUBLE WHEN l2 > so_far OR so_far > 0 THEN 1.0::DOUBLE WHEN second THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS lp FROM alone LEFT JOIN choice USING (track))
"""


def q(body: str, own: str = "own", sums: str = "sums") -> str:
    return CHAIN.replace("{own}", own).replace("{sums}", sums) + body


FIRST = "(SELECT DISTINCT kmer FROM panel_97)"
MASKS_97 = """(SELECT DISTINCT kmer, mask FROM (SELECT kmer, unnest([substr(seq, i - 31, 32), CASE WHEN pos + 64 <= n THEN substr(seq, i + 33, 32) END]) AS mask FROM panel_97) WHERE mask IS NOT NULL)"""

SQL = {
    "kmer_count_canonical": q("SELECT * FROM counts"),
    "kmer_spectrum": q("SELECT total, count(*) AS kmers FROM counts GROUP BY total"),
    "packed_kmers": q(f"SELECT kmer, true AS same, {_rc('kmer')} AS back, CAST(len(regexp_replace(kmer, '[^CG]', '', 'g')) AS BIGINT) AS gc FROM depth_panel"),
    "panel_count": q("SELECT * FROM panel_counts"),
    "panel_count_masked": q(f"""
SELECT p.kmer, CAST(coalesce(sum(CAST(pass AS BIGINT)), 0) AS BIGINT) AS count, CAST(count(pass) AS BIGINT) AS total FROM {FIRST} p LEFT JOIN (
  SELECT w.rid, w.kmer, bool_or({_fits("mask", "w.lf")} OR {_fits("mask", "w.rf")}) AS pass FROM (
    SELECT row_number() OVER () AS rid, {_canon("substr(seq, s + 1, 32)")} AS kmer, CASE WHEN s >= 32 THEN substr(seq, s - 31, 32) END AS lf, CASE WHEN s + 64 <= len(seq) THEN substr(seq, s + 33, 32) END AS rf
    FROM read_windows WHERE {_canon("substr(seq, s + 1, 32)")} IN (SELECT kmer FROM panel_97)) w JOIN {MASKS_97} m USING (kmer) GROUP BY ALL) USING (kmer) GROUP BY p.kmer"""),
    "depth_estimate": q("SELECT coverage, round(std, 6) AS std, rounds FROM settled"),
    "gc_depth": q("SELECT * FROM gc_depth"),
    "gc_window": q("""
SELECT chrom, CAST(gc AS INTEGER) AS gc, count(*) AS n FROM (
  SELECT chrom, n, pos, sum(CAST(substr(seq, pos - base + 1, 1) IN ('C', 'G') AS INTEGER)) OVER (PARTITION BY chrom ORDER BY pos ROWS BETWEEN 234 PRECEDING AND 265 FOLLOWING) // 5 AS gc
  FROM (SELECT *, unnest(range(off, least(n, off + 1024))) AS pos FROM chunks WHERE n > 734)) WHERE pos BETWEEN 234 AND n - 501 GROUP BY ALL"""),
    "del_inner_kmers": q("SELECT * FROM del_kmers"),
    "ins_breakpoint_kmers": q("SELECT * FROM brk_kmers"),
    "ins_body_kmers": q('SELECT track, kmer, chrom, b AS pos, "left", "right", gc FROM ins_loci'),
    "ins_inner_kmers": q("SELECT * FROM ins_kmers"),
    "inner_merge": q("SELECT kmer, count(*) AS tracks, CAST(sum(mult) AS BIGINT) AS mult FROM (SELECT * FROM del_kmers UNION ALL SELECT * FROM ins_kmers) GROUP BY kmer"),
    "reference_loci": q("SELECT * FROM located"),
    "reference_hit_filter": q("SELECT kmer, hits, hits <= 3 AS kept FROM hits"),
    "interest_masks": q("SELECT * FROM masks"),
    "locus_filter": q(f"""
SELECT kmer, chrom, pos, type, CASE WHEN type = 'REF' AND NOT EXISTS (SELECT 1 FROM masks m WHERE m.kmer = n.kmer AND ({_fits('n."left"', "m.mask")} OR {_fits('n."right"', "m.mask")})) THEN 'filtered' ELSE 'active' END AS state FROM named n"""),
    "inverse_kmers": q("SELECT * FROM w_verdict"),
    "preprocess_panel": q("""
SELECT k.kmer, type, inverse, l.loci, t.tracks FROM panel_kmers k JOIN (SELECT kmer, count(*) AS loci FROM panel_loci GROUP BY kmer) l USING (kmer) JOIN (SELECT kmer, count(DISTINCT track) AS tracks FROM panel_tracks GROUP BY kmer) t USING (kmer)"""),
    "genotype_end_to_end": q("""
SELECT track, lp, CASE WHEN lp IS NULL THEN './.' WHEN lp >= 0.75 THEN '1/1' WHEN lp >= 0.25 THEN '1/0' ELSE '0/0' END AS genotype FROM tracks LEFT JOIN calls USING (track)""", "panel_tracks", "panel_sums"),
    "panel_likelihood": q("SELECT kmer, combo, round(ll, 6) AS ll FROM panel_lls"),
    "panel_selection": q("SELECT DISTINCT kmer FROM (SELECT kmer, n, min(n) OVER (PARTITION BY track) AS least FROM panel_chosen) WHERE n = 1 OR least > 1"),
    "panel_components": q("SELECT * FROM clusters", "panel_tracks"),
    "cigar_clips": q("SELECT track, count(*) AS reads, CAST(sum(len(clips)) AS BIGINT) AS clips FROM clip GROUP BY track"),
    "junction_kmers": q("SELECT * FROM across"),
    "present_minus_absent": q('SELECT track, kmer, lf AS "left", rf AS "right" FROM witnesses'),
    "common_kmers": q("SELECT DISTINCT kmer FROM del_kmers WHERE kmer IN (SELECT kmer FROM across)"),
    "kmer_likelihood": q("SELECT kmer, combo, round(ll, 6) AS ll FROM ll_single_combos"),
    "joint_genotype_choice": q("SELECT kmer, combo, round(ll, 6) AS ll FROM best"),
    "select_kmers": q("""
SELECT kmer FROM best b JOIN joint_combos c USING (kmer, combo) LEFT JOIN tracks t USING (track)
WHERE kmer IN (SELECT kmer FROM named GROUP BY kmer HAVING count(*) <= 3) AND kmer IN (SELECT kmer FROM fit GROUP BY kmer HAVING count(DISTINCT track) <= 2 AND max(mult) <= 1)
GROUP BY kmer HAVING bool_and((g > 0) = coalesce(genotype LIKE '%1%', false))"""),
    "nonunique_prune": q("""
SELECT DISTINCT kmer FROM (SELECT kmer, track, n, min(n) OVER (PARTITION BY track) AS least FROM (SELECT kmer, track, count(*) OVER (PARTITION BY kmer) AS n FROM own)) WHERE n = 1 OR least > 1"""),
    "track_components": q("SELECT * FROM clusters"),
    "genotype_calls": q("SELECT track, lp, CASE WHEN lp >= 0.75 THEN '1/1' WHEN lp >= 0.25 THEN '1/0' ELSE '0/0' END AS genotype FROM calls", "fit"),
    "mix_intersection": q("""
SELECT track, kmer FROM across WHERE track IN (SELECT track FROM sample_genotypes GROUP BY track HAVING bool_or(genotype LIKE '%1%') AND NOT bool_or(genotype = './.'))
GROUP BY track, kmer HAVING count(DISTINCT sample) = 2"""),
    "bed_union": q("""
SELECT chrom, b - b % 100 AS "begin", b - b % 100 + 100 AS "end", svtype, genotype FROM tracks QUALIFY row_number() OVER (PARTITION BY chrom, b // 100, svtype ORDER BY partkey % 3, partkey) = 1"""),
    "subsequence_match": q(f"""
SELECT chrom, pos, {_fits("kmer", "lf")} AS in_left, {_fits("kmer", "rf")} AS in_right, (substr(lf, 2, 31) || 'A') LIKE '%' || regexp_replace(substr(lf, 5, 24), '(.)', '\\1%', 'g') AS shifted
FROM (SELECT chrom, pos, kmer, substr(seq, i - 31, 32) AS lf, substr(seq, i + 33, 32) AS rf FROM panel_61 WHERE pos + 64 <= n)"""),
}
