import numpy as np

from tidemark.kernels import matrices, streams

NILE = "1120 1160 963 1210 1160 1160 813 1230 1370 1140 995 935 1110 994 1020 960 1180 799 958 1140 1100 1210 1150 1250 1260 1220 1030 1100 774 840 874 694 940 833 701 916 692 1020 1050 969 831 726 456 824 702 1120 1100 832 764 821 768 845 864 862 698 845 744 796 1040 759 781 865 845 944 984 897 822 1010 771 676 649 846 812 742 801 1040 860 874 848 890 744 749 838 1050 918 986 797 923 975 815 1020 906 901 1170 912 746 919 718 714 740"


def test_local_level_of_the_nile():
    got = matrices.local_level(np.array(NILE.split(), float))
    assert abs(got["noise"] - 15099) < 5 and abs(got["level_noise"] - 1469) < 2


def test_local_level_at_open_ends():
    rng = streams.generator(41)
    alternating = np.tile([1.0, -1.0], 40) + 0.01 * rng.standard_normal(80)
    assert matrices.local_level(alternating)["ratio"] == 0
    walk = np.cumsum(np.cumsum(rng.standard_normal(80)))
    got = matrices.local_level(walk)
    assert got["ratio"] == np.inf and got["noise"] == 0 and abs(got["level_noise"] - (np.diff(walk) ** 2).mean()) < 1e-3 * got["level_noise"]
