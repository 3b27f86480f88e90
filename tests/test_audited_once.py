from conftest import SF

from wardlume import queries


def test_both_scans_of_a_diff_read_written_fingerprints(spark):
    """Else every rule runs over all pages once for each of the two scans."""
    read = queries.fingerprint_diff(spark, SF).inputFiles()
    assert read and all("/fingerprints-" in f for f in read)
