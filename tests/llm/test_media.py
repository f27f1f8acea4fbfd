import numpy as np

from lexmill.llm import media
from lexmill.llm.media import MAX_DISTANCE, copies, keypoints, render

SCHEMA = "image_id bigint, width int, height int, pixels binary, note string"


def smooth(rng, h, w):
    a = rng.integers(0, 256, (h // 4 + 1, w // 4 + 1)).astype(float).repeat(4, 0).repeat(4, 1)[:h, :w]
    return a.astype(np.uint8)


def row(i, a):
    return (i, a.shape[1], a.shape[0], a.tobytes(), None)


def found(spark, images):
    return {(r["image_a"], r["image_b"]): r for r in copies(spark.createDataFrame(images, SCHEMA))[0].collect()}


def groups(spark, images):
    return {r["image_id"]: r["group_id"] for r in copies(spark.createDataFrame(images, SCHEMA))[1].collect()}


def test_crops_shifts_turns_and_edits_are_found(spark):
    rng = np.random.default_rng(9)
    whole = smooth(rng, 120, 160)
    edited = whole.copy()
    edited[40:60, 30:60] = 200
    other = [smooth(rng, 120, 160) for _ in range(6)]
    shifted = np.zeros((140, 180), np.uint8)
    shifted[12:132, 8:168] = whole
    images = [row(1, whole), row(2, whole[16:, 24:]), row(3, edited), row(4, shifted), row(5, np.rot90(whole).copy()), row(6, whole), row(7, whole.repeat(2, 0).repeat(2, 1))] + [row(10 + i, x) for i, x in enumerate(other)]
    got = found(spark, images)
    assert all(a < 10 and b < 10 for a, b in got), "unrelated images match nothing"
    member = groups(spark, images)
    assert {1, 2, 3, 4, 6} <= member.keys() and set(member.values()) == {1}
    pair = lambda x, y: found(spark, [row(1, x), row(2, y)])[1, 2]
    assert (pair(whole, whole[16:, 24:])["dx"], pair(whole, whole[16:, 24:])["dy"]) == (-24, -16)
    assert (pair(whole, shifted)["dx"], pair(whole, shifted)["dy"]) == (8, 12)
    assert pair(whole, whole)["d_turn"] == 0 and pair(whole, np.rot90(whole).copy())["d_turn"] in (8, 24)


def test_groups_equal_those_of_all_pairs(spark):
    """Images that share parts in chains: components over consensus of every pair, computed pair by pair."""
    rng = np.random.default_rng(12)
    strip = smooth(rng, 60, 900)
    images = [row(i, strip[:, 90 * i : 90 * i + 200]) for i in range(7)] + [row(20 + i, smooth(rng, 60, 200)) for i in range(3)]
    linked = [(a[0], b[0]) for i, a in enumerate(images) for b in images[i + 1 :] if found(spark, [a, b])]
    root = {r[0]: r[0] for r in images}
    for _ in images:
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
    size = list(root.values())
    assert groups(spark, images) == {i: r for i, r in root.items() if size.count(r) > 1}


def test_hamming_tables_find_all_matches_of_brute_force(spark):
    rng = np.random.default_rng(10)
    base = smooth(rng, 100, 100)
    noisy = np.clip(base.astype(int) + rng.integers(-1, 2, base.shape), 0, 255).astype(np.uint8)
    (_, _, a), (_, _, b) = keypoints([base]), keypoints([noisy])
    distance = np.bitwise_count(a[:, None] ^ b[None]).sum(2)
    close = np.argwhere(distance <= MAX_DISTANCE)
    blocks = lambda d: np.ascontiguousarray(d).view(np.uint32).reshape(len(d), 4)
    assert len(close) and all((blocks(a)[i] == blocks(b)[j]).any() for i, j in close)
    assert (1, 2) in found(spark, [row(1, base), row(2, noisy)])


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    images = render(pages).collect()
    assert len(images) == pages.count() and all(len(r["pixels"]) == r["width"] * r["height"] for r in images)
    text = "<head><title>t</title></head><body>" + " ".join(f"k{i % 71}x{i}" for i in range(900)) + "</body>"
    more = spark.createDataFrame([(9001, "u", text), (9002, "u", text.replace("k5x5 ", "")), (9003, "u", text.replace("<body>", "<body ><!-- new -->")), (9004, None, None), (9005, "", "")], "page_id bigint, url string, html string")
    got = {r["image_id"]: r["group_id"] for r in copies(render(more))[1].collect()}
    assert got == {9001: 9001, 9002: 9001, 9003: 9001, 9004: 9004, 9005: 9004}


def test_stacking_changes_nothing():
    rng = np.random.default_rng(13)
    images = [smooth(rng, h, 64) for h in (20, 15, 90, 41, 64, 200)]
    image, p, d = keypoints(images)
    for i, a in enumerate(images):
        _, own, strings = keypoints([a])
        assert sorted(map(tuple, own)) == sorted(map(tuple, p[image == i]))
        assert sorted(strings.tolist()) == sorted(d[image == i].tolist())


def test_odd_rows(spark):
    a = smooth(np.random.default_rng(11), 60, 60)
    images = [row(1, a), row(1, a), (None, 60, 60, a.tobytes(), None), (2, 60, 60, None, None), (3, 7, 7, a.tobytes(), None), (4, None, None, a.tobytes(), None), row(5, np.full((50, 50), 9, np.uint8)), (6, 0, 0, b"", None)]
    assert found(spark, images) == {}
    assert found(spark, []) == {}


def textures(words):
    """The picture that render() makes of words."""
    nibble = (words[:, None] >> (np.arange(16, dtype=np.uint64) * np.uint64(4))) & np.uint64(15)
    grid = np.zeros((-(-len(words) // 16) * 16, 4, 4), np.uint8)
    grid[: len(words)] = (nibble * np.uint64(17)).astype(np.uint8).reshape(-1, 4, 4)
    return grid.reshape(-1, 16, 4, 4).swapaxes(1, 2).reshape(-1, 64)


def test_short_pages_keep_crops_and_edits(spark):
    """Pages of 100 to 400 words: every half and every copy with 5% of the words replaced is found, and nothing else, as by comparing all pictures pixel by pixel."""
    rng = np.random.default_rng(14)
    images, want = [], {}
    for n in (100, 113, 150, 177, 220, 250, 274, 300, 340, 352, 360, 400):
        words = rng.integers(0, 1 << 63, n).astype(np.uint64)
        edited = words.copy()
        edited[rng.choice(n, n // 20, replace=False)] = rng.integers(0, 1 << 63, n // 20).astype(np.uint64)
        whole, at = textures(words), 10 * len(images)
        half = len(whole) // 2
        group = [whole, whole[half:], whole[:half], textures(edited)]
        images += [row(at + i, a) for i, a in enumerate(group)]
        want |= {at + i: at for i in range(len(group))}
    sight = [np.frombuffer(r[3], np.uint8).reshape(r[2], r[1]) for r in images]
    alike = {(a[0], b[0]) for i, a in enumerate(images) for j, b in enumerate(images) if i < j and max((sight[i][y : y + len(sight[j])] == sight[j][: len(sight[i]) - y]).mean() for y in range(max(1, len(sight[i]) - len(sight[j]) + 1))) > 0.8}
    assert {b for _, b in alike} == want.keys() - set(want.values()) and all(want[a] == want[b] for a, b in alike)
    assert groups(spark, images) == want


def test_strings_that_an_image_repeats_count(spark):
    """A tiled picture has every string in several places; what agrees with an edit of it is found, and every image has its row."""
    rng = np.random.default_rng(15)
    tiled = np.tile(smooth(rng, 32, 32), (3, 4))
    edited = tiled.copy()
    edited[:, 70:] = smooth(rng, 96, 58)
    images = [row(1, tiled), row(2, edited), row(3, smooth(rng, 96, 128)), (4, 60, 60, None, None)]
    _, _, d = keypoints([tiled])
    assert len(np.unique(d, axis=0)) < len(d) / 2
    assert {(r["image_id"], r["group_id"], r["keep"]) for r in media.classes(spark.createDataFrame(images, SCHEMA)).collect()} == {(1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True)}


def test_matches_and_consensus_in_pieces_equal_brute_force(monkeypatch):
    rng = np.random.default_rng(16)
    a = rng.integers(0, 1 << 63, (90, 2)).astype(np.uint64)
    b = np.concatenate([a[:50], a[20:40] ^ np.uint64(1 << 40 | 1), a[60:] ^ np.uint64(7)])
    a, b = (np.ascontiguousarray(x[np.lexsort((x[:, 1], x[:, 0]))]) for x in (np.concatenate([a, a[:30], a[:30]]), b))
    want = {tuple(x) for x in np.argwhere(np.bitwise_count(a[:, None] ^ b[None]).sum(2) <= MAX_DISTANCE).tolist()}
    votes = lambda: [(int(i), int(j)) for x, y in media._matches(a, b) for i, j in zip(x, y, strict=True)]
    assert len(votes()) == len(want) and set(votes()) == want
    place = lambda n: np.arange(n, dtype=np.int64) % 13 << 8 | np.arange(n, dtype=np.int64) // 13 << 33 | 32
    qa, qb = place(len(a)), place(len(b))
    i, j = map(np.array, zip(*votes(), strict=True))
    whole = media._consensus(np.zeros(len(i), np.int64), qa[i], qb[j], 4)
    monkeypatch.setattr(media, "PAIRS", 7)
    assert len(votes()) == len(want) and set(votes()) == want
    assert whole and media._many(a, qa, b, qb, 4)
    most = max(r[1][0] for r in whole)
    assert {r[1:] for r in media._many(a, qa, b, qb, most)} == {r[1:] for r in whole if r[1][0] == most}


def test_frequent_strings_meet_by_what_images_share(spark, monkeypatch):
    """Two parts that all images have, two images each at the same distance of each other: groups are those of consensus of all pairs, and chance pairs are not verified one by one."""
    rng = np.random.default_rng(17)
    parts = [smooth(rng, 26, 26) for _ in range(2)]
    sight = [smooth(rng, 200, 64) for _ in range(52)]
    for i, a in enumerate(sight):
        y, x = rng.integers(0, (11, 15))
        for part, down, right in zip(parts, (0, 30 + 10 * (i % 13)), (0, 20 * (i % 26 // 13)), strict=True):
            a[y + down : y + down + 26, x + right : x + right + 26] = part
    image, p, d = keypoints(sight)
    place = ((2 * p[:, 1]).astype(np.int64) << 31) | ((2 * p[:, 0]).astype(np.int64) << 7) | (p[:, 2].astype(np.int64) + 1 << 5) | p[:, 3].astype(np.int64)
    root, met = list(range(len(sight))), 0
    own = [np.flatnonzero(image == i) for i in range(len(sight))]
    own = [x[np.lexsort((place[x], d[x, 1], d[x, 0]))] for x in own]
    for i in range(len(sight)):
        for j in range(i + 1, len(sight)):
            votes = [np.empty((2, 0), int), *(np.stack(x) for x in media._matches(np.ascontiguousarray(d[own[i]]), np.ascontiguousarray(d[own[j]])))]
            a, b = np.concatenate(votes, 1)
            met += len(a) > 1
            if media._consensus(np.zeros(len(a), np.int64), place[own[i]][a], place[own[j]][b], 4):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    verified, whole = [], media._verified
    monkeypatch.setattr(media, "_verified", lambda corners, wanted, *more: verified.append(wanted.count()) or whole(corners, wanted, *more))
    rows = media.classes(spark.createDataFrame([row(i, a) for i, a in enumerate(sight)], SCHEMA)).collect()
    assert 30 < len(set(root)) < 48
    assert {r["image_id"]: r["group_id"] for r in rows} == dict(enumerate(root))
    assert sum(verified) < met / 4, (verified, met)
